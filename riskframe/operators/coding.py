"""Category codes, standardisation, median imputation and alignment to a training schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators.joins import Lookup, lookup_join
from riskframe.operators.ordering import SINGLE_TASK_ROWS, dense_codes, exact_quantiles
from riskframe.schema import ID, LABEL, TIME, nan_to_null

# Columns that are never model inputs, and the class name of a missing string.
EXCLUDED_COLS = ["TransactionID", "isFraud", "TransactionDT"]
NULL_CLASS = "nan"


def feature_columns(df: DataFrame, label: str = LABEL, drop: Sequence[str] = ()) -> list[str]:
    excluded = {*EXCLUDED_COLS, label, *drop}
    return [c for c in df.columns if c not in excluded]


def split_xy(df: DataFrame, label: str = LABEL, drop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Features without identifiers, target and time; and the target alone."""
    if label not in df.columns:
        raise KeyError(f"label column '{label}' not found in DataFrame")
    return df.select(*feature_columns(df, label, drop)), df.select(F.col(label).cast("int").alias(label))


def align_columns(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns in training order: missing ones become 0, extra ones are dropped."""
    have = set(df.columns)
    return df.select(*keep, *[F.col(c) if c in have else F.lit(0).alias(c) for c in columns])


def string_columns(df: DataFrame, label: str = LABEL, drop: Sequence[str] = ()) -> list[str]:
    inputs = set(feature_columns(df, label, drop))
    return [f.name for f in df.schema.fields if f.name in inputs and isinstance(f.dataType, T.StringType)]


def category_table(
    df: DataFrame, columns: Sequence[str], null_class: str | None = NULL_CLASS, single_task_rows: int | None = None
) -> DataFrame:
    """(column, value, code, n): alphabetical 0-based codes of each string column, one pass for all columns.

    With `null_class` a missing value is a class of that name; without it, missing values have no code.
    """
    value = lambda c: F.coalesce(F.col(c), F.lit(null_class)) if null_class is not None else F.col(c)
    pairs = [F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns]
    distinct = (
        df.select(F.inline(F.array(*pairs)))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return dense_codes(distinct, "column", "value", "code", single_task_rows)


@dataclass(frozen=True)
class LabelEncoders:
    """Fitted codes per column. Unseen values get code 0, as does whatever sorts first."""

    tables: dict[str, Lookup]

    @classmethod
    def of_stacked(cls, table: DataFrame, columns: Sequence[str]) -> LabelEncoders:
        """From the table that `stacked` gives."""
        sizes = {r["column"]: r["count"] for r in table.groupBy("column").count().collect()}  # one per column
        part = lambda c: table.where(F.col("column") == c).select("value", "code", "n")
        return cls({c: Lookup(part(c), ("value",), sizes.get(c, 0), "n") for c in columns})

    def stacked(self) -> DataFrame:
        out = None
        for name, lookup in self.tables.items():
            part = lookup.table.select(F.lit(name).alias("column"), F.col("value"), F.col("code"), F.col("n"))
            out = part if out is None else out.unionByName(part)
        return out


def fit_label_encoders(
    train: DataFrame, label_col: str = LABEL, drop_cols: Sequence[str] = (), columns: Sequence[str] | None = None
) -> LabelEncoders:
    names = list(columns) if columns is not None else string_columns(train, label_col, drop_cols)
    if not names:
        return LabelEncoders({})
    stored = Lookup.build(category_table(train, names), ["column", "value"], "n")
    return LabelEncoders.of_stacked(stored.table, names)


def apply_codes(
    df: DataFrame, encoders: LabelEncoders, null_class: str | None = NULL_CLASS, unseen: int = 0
) -> DataFrame:
    """Replace each encoded column by its integer code. `null_class=None, unseen=-1` gives category codes."""
    out = df
    spread = ID if ID in df.columns else TIME if TIME in df.columns else df.columns[0]
    for name, lookup in encoders.tables.items():
        if name not in df.columns:
            continue
        value = F.coalesce(F.col(name), F.lit(null_class)) if null_class is not None else F.col(name)
        keyed = out.withColumn("__value", value)
        codes = replace(lookup.select(F.col("value").alias("__value"), "code", "n"), keys=("__value",))
        coded = lookup_join(keyed, codes, {"__code": F.col("code")}, spread_by=spread)
        out = coded.withColumn(name, F.coalesce("__code", F.lit(unseen)).cast("int")).drop("__code", "__value")
    return out.select(*df.columns)


def prepare_features(
    df: DataFrame,
    label_col: str = LABEL,
    drop_cols: Sequence[str] = (),
    label_encoders: LabelEncoders | None = None,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, list[str]]:
    """Numeric model input: (`keep` + label + features) and the names of the coded columns."""
    if label_col not in df.columns:
        raise KeyError(f"label column '{label_col}' not found in DataFrame")
    strings = string_columns(df, label_col, drop_cols)
    encoders = label_encoders if label_encoders is not None else fit_label_encoders(df, label_col, drop_cols)
    coded = apply_codes(df, encoders)
    features = [c for c in feature_columns(df, label_col, drop_cols) if c not in keep]
    return coded.select(*keep, F.col(label_col).cast("int").alias(label_col), *features), strings


@dataclass(frozen=True)
class Scaler:
    """Population standardisation: NULL counts as 0, a constant column keeps scale 1."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str]) -> Scaler:
        row = scaler_statistics(df, features).collect()
        by_name = {r["feature"]: r for r in row}  # one row per feature
        means = tuple(by_name[f]["mean"] for f in features)
        return cls(tuple(features), means, tuple(by_name[f]["scale"] for f in features))

    def columns(self) -> list[Column]:
        zero = lambda f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0))
        return [((zero(f) - m) / s).alias(f) for f, m, s in zip(self.features, self.means, self.scales)]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.select(*keep, *self.columns())


def scaler_statistics(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean, scale) from one aggregation."""
    aggs = []
    for i, f in enumerate(features):
        v = F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0))
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
    scale = lambda i: F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(F.lit(1.0))
    items = [
        F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("mean"), scale(i).alias("scale"))
        for i, f in enumerate(features)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def median_table(df: DataFrame, columns: Sequence[str]) -> Mapping[str, float]:
    """Exact median of each column, NULL and NaN left out."""
    df = nan_to_null(df.select(*columns))
    if df.count() <= SINGLE_TASK_ROWS:
        row = df.agg(*[F.median(F.col(c)).alias(c) for c in columns]).first()
        return {c: row[c] for c in columns}
    # one long table of (column, value), so that the number of jobs does not grow with the columns
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    long = df.select(F.inline(F.array(*pairs))).where("value IS NOT NULL")
    found = {r["column"]: r["q"][0] for r in exact_quantiles(long, "value", [0.5], by=["column"]).collect()}
    return {c: found.get(c) for c in columns}


def impute_median(df: DataFrame, columns: Sequence[str], medians: Mapping[str, float] | None = None) -> DataFrame:
    """Fill NULLs of numeric columns with the median of the column."""
    values = medians if medians is not None else median_table(df, columns)
    filled = nan_to_null(df, columns)
    return filled.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(values[c]).cast("double")) for c in columns})
