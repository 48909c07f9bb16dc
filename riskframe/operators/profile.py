"""Dataset profiling: class balance, missingness, time, amount and coverage tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskframe.functions import columns as C
from riskframe.operators.ordering import exact_quantiles
from riskframe.schema import AMOUNT, CORE_TYPES, LABEL, TIME, identity_columns, nan_to_null, vendor_columns

# Profiling defaults.
TIME_BINS = 500
MA_BINS = 20
HIST_EDGES = 80
HIST_LOW = 0.5
BOX_CLIP = 2_000.0
NULL_PCT_FLOOR = 5.0


def _ratio(top: Column, bottom: Column) -> Column:
    return top / F.nullif(bottom, F.lit(0))


def class_balance(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Counts per class, label rate, negatives per positive, and the positive class weight."""
    positives, negatives = F.sum(F.col(label).cast("long")), F.sum(1 - F.col(label).cast("long"))
    counted = df.agg(negatives.alias("n_legit"), positives.alias("n_fraud"))
    n0, n1 = F.col("n_legit"), F.col("n_fraud")
    return counted.select(
        "n_legit",
        "n_fraud",
        _ratio(n1, n0 + n1).alias("fraud_rate"),
        _ratio(n0, n1).alias("imbalance_ratio"),
        (n0 / F.greatest(n1, F.lit(1))).alias("scale_pos_weight"),
    )


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, null_pct) for all columns, from a single aggregation of the table."""
    names = list(columns or df.columns)
    df = nan_to_null(df, names)
    shares = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100.0).alias(f"p{i}") for i, c in enumerate(names)])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"p{i}").alias("null_pct")) for i, c in enumerate(names)]
    return shares.select(F.inline(F.array(*pairs)))


def null_counts(df: DataFrame) -> DataFrame:
    """How many columns have any, more than half, and more than nine tenths of their values missing."""
    over = lambda pct, name: F.sum((F.col("null_pct") > pct).cast("long")).alias(name)
    return null_profile(df).agg(over(0, "n_any_null"), over(50, "n_over_50"), over(90, "n_over_90"))


def column_families(columns: Sequence[str]) -> dict[str, list[str]]:
    """Logical families of the wide table; only the columns that exist."""
    numbered = {int(c[1:]): c for c in vendor_columns(columns)}
    vendor = lambda low, high: [numbered[i] for i in range(low, high) if i in numbered]
    core = [c for c in CORE_TYPES if c not in ("isFraud", "DeviceType", "DeviceInfo")]
    families = {
        "Core": [c for c in core if c in columns],
        "M features": [c for c in columns if c.startswith("M")],
        "C features": [c for c in columns if c.startswith("C")],
        "D features": [c for c in columns if c.startswith("D") and not c.startswith("Device")],
        "V features (1-100)": vendor(1, 101),
        "V features (101-200)": vendor(101, 201),
        "V features (201-339)": vendor(201, 340),
        "Identity": identity_columns(columns),
    }
    return {name: cols for name, cols in families.items() if cols}


def family_null_profile(df: DataFrame, families: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Mean null percentage and number of columns per family."""
    chosen = families or column_families(df.columns)
    names = sorted({c for cols in chosen.values() for c in cols})
    member = F.array(
        *[
            F.struct(F.lit(f).alias("family"), F.array(*[F.lit(c) for c in cols]).alias("members"))
            for f, cols in chosen.items()
        ]
    )
    return (
        null_profile(df, names)
        .select("null_pct", "column", F.inline(member))
        .where(F.array_contains("members", F.col("column")))
        .groupBy("family")
        .agg(F.avg("null_pct").alias("mean_null_pct"), F.count(F.lit(1)).alias("n_columns"))
    )


def missingness_vs_label(
    df: DataFrame, label: str = LABEL, min_null_pct: float = NULL_PCT_FLOOR
) -> DataFrame:
    """Label rate of rows where a column is missing against rows where it is present, one scan for all columns.

    All columns above the floor are returned; `top_n` takes a head of them.
    """
    df = nan_to_null(df)
    names = [c for c in df.columns if c != label]
    y = F.col(label).cast("long")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("y")]
    for i, c in enumerate(names):
        missing = F.col(c).isNull()
        aggs += [F.sum(missing.cast("long")).alias(f"n{i}"), F.sum(F.when(missing, y).otherwise(0)).alias(f"y{i}")]
    fields = [
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_null"), F.col(f"y{i}").alias("y_null"))
        for i, c in enumerate(names)
    ]
    rates = df.agg(*aggs).select("n", "y", F.inline(F.array(*fields)))
    if_null = _ratio(F.col("y_null"), F.col("n_null"))
    if_present = _ratio(F.col("y") - F.col("y_null"), F.col("n") - F.col("n_null"))
    return (
        rates.select(
            "column",
            _ratio(100.0 * F.col("n_null"), F.col("n")).alias("null_pct"),
            if_null.alias("fraud_rate_if_null"),
            if_present.alias("fraud_rate_if_present"),
            (if_null - if_present).alias("delta"),
        )
        .where(F.col("null_pct") > min_null_pct)
        .orderBy(F.desc("delta"), "column")
    )


def time_buckets(df: DataFrame, bins: int = TIME_BINS, label: str = LABEL, time: str = TIME) -> DataFrame:
    """Label rate, count and median time in equal-width right-closed bins over the time range."""
    span = df.agg(F.struct(F.min(time).alias("lo"), F.max(time).alias("hi")).alias("s")).scalar()
    width = F.greatest(span["hi"] - span["lo"], F.lit(1))
    step = (F.col(time) - span["lo"]) * bins
    right_closed = F.floor((step + width - 1) / width) - 1
    binned = df.where(F.col(time).isNotNull()).select(
        F.greatest(right_closed, F.lit(0)).cast("int").alias("bin"), F.col(time).alias("t"), F.col(label).alias("y")
    )
    rates = binned.groupBy("bin").agg(F.avg("y").alias("fraud_rate"), F.count("y").alias("count"))
    middle = exact_quantiles(binned, "t", [0.5], by=["bin"])
    return rates.join(middle, "bin").select("bin", "fraud_rate", "count", F.col("q")[0].alias("dt_mid"))


def centred_moving_average(buckets: DataFrame, value: str = "fraud_rate", width: int = MA_BINS) -> DataFrame:
    """Adds `<value>_ma`: mean of `width` neighbouring bins, NULL near the ends. Input: one row per bin."""
    frame = W.orderBy("bin").rowsBetween(-(width // 2), width - width // 2 - 1)
    full = F.count(value).over(frame) == width
    return buckets.withColumn(f"{value}_ma", F.when(full, F.avg(value).over(frame)))


def median_bin_step(buckets: DataFrame) -> DataFrame:
    """Median distance between the mid-points of adjacent bins. Input: one row per bin."""
    step = F.col("dt_mid") - F.lag("dt_mid").over(W.orderBy("bin"))
    return buckets.select(step.alias("step")).agg(F.median("step").alias("median_step"))


def hour_profile(df: DataFrame, label: str = LABEL) -> DataFrame:
    hour = C.hour_of_day(F.col(TIME)).alias("hour")
    return df.groupBy(hour).agg(F.avg(label).alias("fraud_rate"), F.count(label).alias("count"))


def peak_hour(df: DataFrame, label: str = LABEL) -> DataFrame:
    return hour_profile(df, label).orderBy(F.desc("fraud_rate"), "hour").limit(1)


def day_profile(df: DataFrame, label: str = LABEL) -> DataFrame:
    day = C.day_of_week(F.col(TIME)).alias("dow")
    rates = df.groupBy(day).agg(F.avg(label).alias("fraud_rate"), F.count(label).alias("count"))
    return rates.withColumn("dow_label", C.day_name(F.col("dow")))


def class_amounts(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Mean and median amount per class."""
    means = df.groupBy(label).agg(F.avg(AMOUNT).alias("mean_amt"))
    middle = exact_quantiles(df, AMOUNT, [0.5], by=[label])
    return means.join(middle, label).select(label, "mean_amt", F.col("q")[0].alias("median_amt"))


def log_histogram(df: DataFrame, label: str = LABEL, edges: int = HIST_EDGES, low: float = HIST_LOW) -> DataFrame:
    """Log-spaced histogram of the amount from `low` to max + 1, density normalised per class."""
    high = df.agg(F.max(AMOUNT)).scalar()
    start = F.log10(F.lit(low))
    step = (F.log10(high + 1) - start) / (edges - 1)
    binned = (
        df.where(F.col(AMOUNT) >= low)
        .select(F.col(label), F.floor((F.log10(AMOUNT) - start) / step).cast("int").alias("bin"))
        .groupBy(label, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    edge = lambda i: F.pow(F.lit(10.0), start + step * i)
    width = edge(F.col("bin") + 1) - edge(F.col("bin"))
    in_class = F.sum("n").over(W.partitionBy(label))  # at most `edges` rows per class
    return binned.select(label, "bin", "n", (F.col("n") / (in_class * width)).alias("density"))


def box_stats(df: DataFrame, label: str = LABEL, clip_at: float = BOX_CLIP) -> DataFrame:
    """Quartiles and 1.5 IQR whiskers of the clipped amount per class."""
    clipped = df.where(F.col(AMOUNT).isNotNull()).select(label, F.least(AMOUNT, F.lit(clip_at)).alias("v"))
    quartiles = exact_quantiles(clipped, "v", [0.25, 0.5, 0.75], by=[label]).select(
        label, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = lambda fn, test: fn(F.when(test, F.col("v")))
    return (
        clipped.join(F.broadcast(quartiles), label)  # one row per class
        .groupBy(label, "q1", "median", "q3")
        .agg(
            inside(F.min, F.col("v") >= F.col("q1") - reach).alias("whisker_low"),
            inside(F.max, F.col("v") <= F.col("q3") + reach).alias("whisker_high"),
        )
    )


def identity_coverage(df: DataFrame, label: str = LABEL, proxy: str | None = None) -> DataFrame:
    """Share of rows with an identity record, and the label rate with and without one."""
    column = proxy or next(c for c in df.columns if c.startswith("id_"))
    has = F.col(column).isNotNull()
    rates = df.agg(
        (F.avg(has.cast("double")) * 100.0).alias("coverage_pct"),
        F.avg(F.when(has, F.col(label))).alias("fraud_rate_with"),
        F.avg(F.when(~has, F.col(label))).alias("fraud_rate_without"),
    )
    return rates.withColumn("delta_pp", 100.0 * (F.col("fraud_rate_with") - F.col("fraud_rate_without")))


def describe_by_class(df: DataFrame, value: str, label: str = "y") -> DataFrame:
    """Count, mean, std, min, quartiles and max of `value` per class, all exact."""
    v = F.col(value)
    basic = df.groupBy(label).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], by=[label])
    return basic.join(q, label).select(
        "*", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75")
    ).drop("q")


def dataset_summary(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Key/value table of the whole dataset, from one aggregation."""
    names = df.columns
    null_share = [F.avg(F.col(c).isNull().cast("double")).alias(f"p{i}") for i, c in enumerate(names)]
    proxy = next((c for c in names if c.startswith("id_")), None)
    coverage = F.avg(F.col(proxy).isNotNull().cast("double")) if proxy else F.lit(None).cast("double")
    one = df.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg(label).alias("rate"),
        ((F.max(TIME) - F.min(TIME)) / C.DAY).alias("days"),
        coverage.alias("coverage"),
        *null_share,
    )
    over = lambda limit: sum(
        ((F.col(f"p{i}") > limit).cast("double") for i in range(1, len(names))), (F.col("p0") > limit).cast("double")
    )
    items = {
        "total_transactions": F.col("n"),
        "fraud_rate": F.col("rate"),
        "imbalance_ratio": _ratio(1 - F.col("rate"), F.col("rate")),
        "total_columns": F.lit(float(len(names))),
        "columns_with_null": over(0.0),
        "columns_over_half_null": over(0.5),
        "vendor_columns": F.lit(float(len(vendor_columns(names)))),
        "duration_days": F.col("days"),
        "identity_join_rate": F.col("coverage"),
    }
    pairs = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in items.items()]
    return one.select(F.inline(F.array(*pairs)))


def rank_by(df: DataFrame, name: str, value: str, top_n: int | None = None) -> DataFrame:
    """Rows by falling `value`, with rank and share (%) of the total of all rows; `top_n` keeps the head only."""
    top = df.select(name, value, df.agg(F.sum(value)).scalar().alias("__total"))
    if top_n is not None:
        top = top.orderBy(F.desc(value), name).limit(top_n)
    return top.select(
        name,
        value,
        F.row_number().over(W.orderBy(F.desc(value), name)).alias("rank"),
        F.round(_ratio(100.0 * F.col(value), F.col("__total")), 2).alias("importance_pct"),
    )


def top_n(df: DataFrame, by: str, n: int, absolute: bool = False, tie: str | None = None) -> DataFrame:
    """Head of the table sorted descending by `by`, or by its absolute value."""
    key = F.abs(F.col(by)) if absolute else F.col(by)
    return df.orderBy(key.desc(), *([tie] if tie else [])).limit(n)
