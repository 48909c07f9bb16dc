"""Smallest column types that hold the data, decided by one aggregation over all columns."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

logger = logging.getLogger(__name__)

# The integer ranges and the largest 32-bit float.
INTEGERS = (("tinyint", -(2**7), 2**7 - 1), ("smallint", -(2**15), 2**15 - 1), ("int", -(2**31), 2**31 - 1))
FLOAT_MAX = 3.4028234663852886e38
BYTES = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1}


def _target(field: T.StructField, low: Column, high: Column) -> Column:
    old = field.dataType
    if isinstance(old, T.BooleanType):
        return F.lit("tinyint")
    if isinstance(old, T.IntegralType):
        kept = F.lit(old.simpleString())
        chosen: Column | None = None
        for name, least, most in INTEGERS:
            if BYTES[name] < BYTES[old.simpleString()]:
                fits = (low >= least) & (high <= most)
                chosen = F.when(fits, name) if chosen is None else chosen.when(fits, name)
        return kept if chosen is None else chosen.otherwise(kept)
    if isinstance(old, T.DoubleType):
        return F.when((low >= -FLOAT_MAX) & (high <= FLOAT_MAX), "float").otherwise("double")
    return F.lit(old.simpleString())


def narrowing_plan(df: DataFrame) -> DataFrame:
    """(column, old_type, new_type, min, max). An all-NULL column keeps its type; text stays text."""
    numeric = lambda f: isinstance(f.dataType, T.NumericType) and not isinstance(f.dataType, T.DecimalType)
    aggs, items = [F.count(F.lit(1)).alias("__rows")], []
    for i, field in enumerate(df.schema.fields):
        low = high = F.lit(None).cast("double")
        new = _target(field, low, high)
        if numeric(field):
            aggs += [F.min(field.name).alias(f"lo{i}"), F.max(field.name).alias(f"hi{i}")]
            low, high = F.col(f"lo{i}"), F.col(f"hi{i}")
            new = F.when(low.isNull(), F.lit(field.dataType.simpleString())).otherwise(_target(field, low, high))
        items.append(
            F.struct(
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("old_type"),
                new.alias("new_type"),
                low.cast("double").alias("min"),
                high.cast("double").alias("max"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def narrow_schema(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`df` cast to the narrow types, and the plan table behind it."""
    plan = narrowing_plan(df)
    rows = {r["column"]: r for r in plan.collect()}  # one row per column
    casts = {c: F.col(c).cast(r["new_type"]) for c, r in rows.items() if r["new_type"] != r["old_type"]}
    size = lambda key: sum(BYTES.get(r[key], 0) for r in rows.values())
    before, after = size("old_type"), size("new_type")
    logger.info("narrowed fixed-width bytes per row: %d -> %d (%.1f%% saved)", before, after, 100 * (1 - after / max(before, 1)))
    return (df.withColumns(casts) if casts else df), plan
