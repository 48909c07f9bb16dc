"""Reading the two input tables, the saved splits and the cached intermediate tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators.joins import merge_tables
from riskframe.operators.split import SPLITS
from riskframe.schema import column_type
from riskframe.sources.narrowing import narrow_schema

FORMATS = ("parquet", "csv")
#: How CSV splits are written and read, so that NULL, empty text, blanks, quotes and microseconds come back.
MISSING = "\\N"
CSV_SPLIT = {
    "header": True, "nullValue": MISSING, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
WHOLE = T.DecimalType(38, 6)  # how whole numbers are read from text


def _read(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None, **options
) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    try:
        return (reader.schema(schema) if schema is not None else reader).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no data at {path}: run the step that writes it first") from error
        raise


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; a missing path is a FileNotFoundError."""
    return _read(spark, path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, infer: bool = False) -> DataFrame:
    """CSV with a header. Types come from the declared schema, by column name, without a pass over the data.

    Whole numbers may be written with decimals, as in `315.0`. A field that does not fit its type, or a whole number
    with a fraction, fails the read instead of becoming NULL.
    """
    if infer:
        return _read(spark, path, "csv", header=True, inferSchema=True)
    if schema is None:
        names = _read(spark, path, "csv", header=True).columns
        schema = T.StructType([T.StructField(n, column_type(n)) for n in names])
    whole = {f.name: f.dataType for f in schema.fields if isinstance(f.dataType, (T.LongType, T.IntegerType))}
    written = T.StructType([T.StructField(f.name, WHOLE if f.name in whole else f.dataType) for f in schema.fields])
    rows = _read(spark, path, "csv", written, header=True, mode="FAILFAST")

    def number(name: str) -> Column:
        value = F.col(name)
        wrong = F.raise_error(F.concat(F.lit(f"{name} is no whole number: "), value.cast("string")))
        return F.when(value.isNull() | (value % 1 == 0), value.cast(whole[name])).otherwise(wrong.cast(whole[name]))

    return rows.withColumns({name: number(name) for name in whole}) if whole else rows


def load_transactions(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    return read_csv(spark, path, infer=infer)


def load_identity(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    return read_csv(spark, path, infer=infer)


def load_and_merge(spark: SparkSession, txn_path: str, identity_path: str, narrow: bool = False) -> DataFrame:
    """Both CSV tables, left-joined; `narrow` casts to the smallest types that hold the data."""
    both = merge_tables(load_transactions(spark, txn_path), load_identity(spark, identity_path))
    return narrow_schema(both)[0] if narrow else both


def save_splits(train: DataFrame, val: DataFrame, test: DataFrame, out_dir: str, fmt: str = "parquet") -> dict[str, str]:
    """Writes one folder per split and returns their paths.

    Beside a CSV split stands `<name>.schema`: its column types, and whether texts hold line breaks. Both are learnt while
    it is written. A text that reads like the mark of a missing value (`MISSING`) is refused.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format '{fmt}', choose 'parquet' or 'csv'")
    paths = {}
    for name, part in zip(SPLITS, (train, val, test)):
        paths[name] = f"{out_dir}/{name}.{fmt}"
        if fmt == "csv":
            _save_csv(part, paths[name], f"{out_dir}/{name}.schema")
        else:
            part.write.mode("overwrite").parquet(paths[name])
    return paths


def _save_csv(part: DataFrame, path: str, schema_path: str) -> None:
    texts = [F.col(f"`{f.name}`") for f in part.schema.fields if isinstance(f.dataType, T.StringType)]
    some = lambda test: F.coalesce(F.max(F.greatest(F.lit(False), F.lit(False), *[test(c) for c in texts])), F.lit(False))
    seen = Observation()
    watched = part.observe(seen, some(lambda c: c.rlike("[\\r\\n]")).alias("breaks"), some(lambda c: c == MISSING).alias("clash"))
    watched.write.mode("overwrite").options(**CSV_SPLIT).csv(path)
    if seen.get["clash"]:
        raise ValueError(f"a text equals {MISSING}, the mark of missing values: save the splits as parquet")
    manifest = json.dumps({"schema": part.schema.jsonValue(), "breaks": seen.get["breaks"]})
    rows = part.sparkSession.createDataFrame([(manifest,)], "value string")
    rows.coalesce(1).write.mode("overwrite").text(schema_path)


def _load_csv(spark: SparkSession, path: str, schema_path: str) -> DataFrame:
    """By the schema beside it; a folder without one is read with inferred types."""
    try:
        manifest = json.loads(_read(spark, schema_path, "text").first()["value"])
    except FileNotFoundError:
        return read_csv(spark, path, infer=True)
    schema = T.StructType.fromJson(manifest["schema"])
    return _read(spark, path, "csv", schema, mode="FAILFAST", multiLine=manifest["breaks"], **CSV_SPLIT)


def load_splits(spark: SparkSession, in_dir: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame, DataFrame]:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format '{fmt}', choose 'parquet' or 'csv'")
    at = lambda name: f"{in_dir}/{name}"
    if fmt == "csv":
        train, val, test = (_load_csv(spark, at(f"{n}.csv"), at(f"{n}.schema")) for n in SPLITS)
    else:
        train, val, test = (_read(spark, at(f"{n}.parquet")) for n in SPLITS)
    return train, val, test


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at `path`; if it is absent it is built, written and read back."""
    try:
        return _read(spark, path)
    except FileNotFoundError:
        build().write.mode("errorifexists").parquet(path)
        return _read(spark, path)


def load_feature_splits(
    spark: SparkSession,
    feature_dir: str,
    raw_dir: str,
    enrich: Callable[[DataFrame, DataFrame, DataFrame], tuple[DataFrame, DataFrame, DataFrame]],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Enriched splits if they were saved, else the raw splits run through `enrich`."""
    try:
        return load_splits(spark, feature_dir)
    except FileNotFoundError:
        return enrich(*load_splits(spark, raw_dir))
