"""Chronological train/validation/test split without a global sort."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.ordering import before_key, kth_keys
from riskframe.schema import ID, LABEL, TIME, require

SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class SplitConfig:
    """Fractions of the train and validation parts; the rest is the test part."""

    train_frac: float = 0.60
    val_frac: float = 0.20
    time_col: str = TIME
    label_col: str = LABEL
    id_col: str = ID

    @property
    def shares(self) -> tuple[float, ...]:
        """Shares of the splits in order; the last one is what the others leave."""
        given = self.train_frac, self.val_frac
        return *given, 1.0 - sum(given)

    @property
    def test_frac(self) -> float:
        return self.shares[-1]

    def cuts(self, rows: int) -> list[int]:
        """Rank of the first row after each split but the last."""
        return [int(rows * end) for end in list(accumulate(self.shares))[:-1]]

    def __post_init__(self) -> None:
        for name, share in zip(SPLITS, self.shares):
            if not 0 < share < 1:
                raise ValueError(f"the {name} split must hold a share strictly between 0 and 1, not {share}")


def assign_split(
    df: DataFrame, config: SplitConfig = SplitConfig(), single_task_rows: int | None = None
) -> DataFrame:
    """Adds `split`. Rows are ranked by (time, id), NULL times last; only the two cut rows are looked up.

    The full table is never sorted or shuffled: each row is compared with two literal cut points.
    """
    require(df, [config.time_col, config.id_col], "assign_split")
    keys = [config.time_col, config.id_col]
    total = df.count()
    names = list(zip(SPLITS, config.cuts(total)))
    inner = [cut for _, cut in names if cut < total]
    at = dict(zip(inner, kth_keys(df, keys, inner, total, single_task_rows)))
    part = F.lit(SPLITS[-1])
    for name, cut in reversed(names):
        part = F.when(before_key(df, keys, at[cut]) if cut < total else F.lit(True), name).otherwise(part)
    return df.withColumn("split", part)


def time_aware_split(df: DataFrame, config: SplitConfig = SplitConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test as three filtered DataFrames, checked for temporal overlap."""
    tagged = assign_split(df, config)
    train, val, test = (tagged.where(F.col("split") == name).drop("split") for name in SPLITS)
    assert_no_overlap(tagged, config)
    return train, val, test


def split_summary(tagged: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """Rows, share, time range and label rate of each split."""
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.min(config.time_col).alias("dt_min"),
        F.max(config.time_col).alias("dt_max"),
    ]
    if config.label_col in tagged.columns:
        aggs.append(F.avg(config.label_col).alias("label_rate"))
    total = tagged.agg(F.count(F.lit(1)).alias("n")).scalar()
    summary = tagged.groupBy("split").agg(*aggs)
    return summary.withColumn("pct_rows", 100.0 * F.col("n_rows") / total)


def overlap_violations(tagged: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """One row per adjacent pair of splits that overlap in time; equal boundary times are allowed."""
    at = lambda fn, name: fn(F.when(F.col("split") == name, F.col(config.time_col)))
    ranges = tagged.agg(
        at(F.max, "train").alias("train_max"),
        at(F.min, "val").alias("val_min"),
        at(F.max, "val").alias("val_max"),
        at(F.min, "test").alias("test_min"),
    )
    pairs = F.array(
        F.struct(
            F.lit("train").alias("earlier"),
            F.lit("val").alias("later"),
            F.col("train_max").alias("earlier_max"),
            F.col("val_min").alias("later_min"),
        ),
        F.struct(
            F.lit("val").alias("earlier"),
            F.lit("test").alias("later"),
            F.col("val_max").alias("earlier_max"),
            F.col("test_min").alias("later_min"),
        ),
    )
    return ranges.select(F.inline(pairs)).where("later_min < earlier_max")


def assert_no_overlap(tagged: DataFrame, config: SplitConfig = SplitConfig()) -> None:
    for row in overlap_violations(tagged, config).collect():  # at most two rows
        raise ValueError(
            f"Temporal overlap between {row['earlier']} and {row['later']}: "
            f"{row['later']} starts at {row['later_min']}, {row['earlier']} ends at {row['earlier_max']}"
        )
