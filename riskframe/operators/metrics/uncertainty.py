"""Interval-width statistics, review queues, routing and model disagreement.

Input columns: `y`, `score_a`, `score_b`, `hdi_width`, `std`. Data-dependent thresholds enter as scalar
subqueries, so each analysis is one aggregation of `scored` without any join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskframe.operators.metrics.ranking import optimal_threshold, ranked_scores
from riskframe.operators.ordering import exact_quantiles, order_profile, running_totals

# Default operating points.
UNCERTAINTY_PERCENTILES = (0.50, 0.60, 0.70, 0.75, 0.80, 0.90)
HEADLINE_PERCENTILE = 0.75
DISAGREEMENT = 0.20
DECISION = 0.5
WIDTH_EDGES = 60
RATIO_FLOOR = 1e-9
CHARGEBACK_MULTIPLIER = 1.5
WIDTH = "hdi_width"


def width_quantile(scored: DataFrame, prob: float = HEADLINE_PERCENTILE) -> Column:
    return exact_quantiles(scored, WIDTH, [prob]).select(F.col("q")[0]).scalar()


def uncertainty_summary(scored: DataFrame, label: str = "y") -> DataFrame:
    y, w = F.col(label), F.col(WIDTH)
    one = lambda v: F.avg(F.when(y == 1, v))
    zero = lambda v: F.avg(F.when(y == 0, v))
    high = (w >= width_quantile(scored)).cast("double")
    return scored.agg(
        F.avg(w).alias("mean_uncertainty_all"),
        one(w).alias("mean_uncertainty_fraud"),
        zero(w).alias("mean_uncertainty_legit"),
        (one(w) / F.greatest(zero(w), F.lit(RATIO_FLOOR))).alias("uncertainty_ratio"),
        (100.0 * F.avg(high)).alias("pct_high_uncertainty_q75"),
        one(F.col("std")).alias("bayes_std_mean_fraud"),
        zero(F.col("std")).alias("bayes_std_mean_legit"),
    )


def best_threshold(scored: DataFrame, score: str = "score_a", label: str = "y") -> Column:
    return optimal_threshold(ranked_scores(scored, [score], label)).select("optimal_threshold").scalar()


def _queues(scored: DataFrame, percentiles: Sequence[float], score: str, label: str) -> DataFrame:
    """One row: totals of the table and an array with one struct per queue."""
    best = best_threshold(scored, score, label)
    data = scored.select(
        (F.col(label) == 1).alias("hit"),
        F.col(WIDTH).alias("w"),
        ((F.col(label) == 1) & (F.col(score) < best)).alias("missed"),
    )
    cuts = exact_quantiles(scored, WIDTH, percentiles).select("q").scalar()
    count = lambda test: F.sum(test.cast("long"))
    aggs = [
        F.count(F.lit(1)).alias("total"),
        count(F.col("hit")).alias("positives"),
        count(F.col("missed")).alias("n_fn"),
    ]
    items = []
    for i, p in enumerate(percentiles):
        queued = F.col("w") >= cuts[i]
        aggs += [
            count(queued).alias(f"size{i}"),
            count(queued & F.col("missed")).alias(f"fn{i}"),
            count(queued & F.col("hit")).alias(f"hit{i}"),
        ]
        size, caught, hits = F.col(f"size{i}"), F.col(f"fn{i}"), F.col(f"hit{i}")
        items.append(
            F.struct(
                F.lit(float(p)).alias("uncertainty_percentile"),
                cuts[i].alias("hdi_width_threshold"),
                size.alias("review_queue_size"),
                (100.0 * size / F.greatest(F.col("total"), F.lit(1))).alias("review_queue_pct_all"),
                caught.alias("fn_caught_in_queue"),
                (100.0 * caught / F.greatest(F.col("n_fn"), F.lit(1))).alias("fn_recovery_pct"),
                hits.alias("fraud_in_queue"),
                (100.0 * hits / F.greatest(size, F.lit(1))).alias("queue_precision_pct"),
            )
        )
    return data.agg(*aggs).select(
        "total", "positives", "n_fn", best.alias("optimal_threshold"), F.array(*items).alias("queues")
    )


def review_queues(
    scored: DataFrame,
    percentiles: Sequence[float] = UNCERTAINTY_PERCENTILES,
    score: str = "score_a",
    label: str = "y",
) -> tuple[DataFrame, DataFrame]:
    """Summary row (misses and the headline queue: p75, or the last one) and one row per review queue."""
    probs = list(percentiles)
    at = probs.index(HEADLINE_PERCENTILE) if HEADLINE_PERCENTILE in probs else len(probs) - 1
    queues, row = _queues(scored, probs, score, label), F.col("queues")[at]
    summary = queues.select(
        "optimal_threshold",
        F.col("n_fn").alias("total_false_negatives"),
        (100.0 * F.col("n_fn") / F.greatest(F.col("positives"), F.lit(1))).alias("fn_miss_rate_pct"),
        row["review_queue_pct_all"].alias("headline_queue_size_pct"),
        row["fn_recovery_pct"].alias("headline_fn_recovery_pct"),
        row["queue_precision_pct"].alias("headline_queue_precision_pct"),
    )
    return summary, queues.select(F.inline("queues"))


def fn_recovery(scored: DataFrame, percentiles: Sequence[float] = UNCERTAINTY_PERCENTILES) -> DataFrame:
    """Missed positives that each uncertainty-guided review queue would surface."""
    return review_queues(scored, percentiles)[1]


def fn_summary(scored: DataFrame, percentiles: Sequence[float] = UNCERTAINTY_PERCENTILES) -> DataFrame:
    return review_queues(scored, percentiles)[0]


def recovery_gain(recovery: DataFrame) -> DataFrame:
    """Recovery of each queue beyond that of a random queue of the same size."""
    return recovery.select(
        "uncertainty_percentile",
        (F.col("review_queue_pct_all") / 100.0).alias("queue_share"),
        (F.col("fn_recovery_pct") / 100.0).alias("recovery"),
        ((F.col("fn_recovery_pct") - F.col("review_queue_pct_all")) / 100.0).alias("gain"),
    )


def route_decisions(scored: DataFrame, score: str = "score_b", prob: float = HEADLINE_PERCENTILE) -> DataFrame:
    """Adds `decision`: uncertain rows go to review, certain ones are declined or approved by the score."""
    uncertain = F.col(WIDTH) >= width_quantile(scored, prob)
    certain = F.when(F.col(score) >= DECISION, "decline").otherwise("approve")
    return scored.withColumn("decision", F.when(uncertain, "review").otherwise(certain))


def cost_exposure(
    scored: DataFrame, amount: str = "TransactionAmt", score: str = "score_a", label: str = "y",
    multiplier: float = CHARGEBACK_MULTIPLIER,
) -> DataFrame:
    """Value lost on missed positives at the best-F1 threshold, with the chargeback multiplier."""
    missed = (F.col(label) == 1) & (F.col(score) < best_threshold(scored, score, label))
    return scored.agg(
        F.sum(missed.cast("long")).alias("n_missed"),
        F.sum(F.when(missed, multiplier * F.col(amount)).otherwise(0.0)).alias("exposure"),
    )


def disagreement(
    scored: DataFrame,
    threshold: float = DISAGREEMENT,
    a: str = "score_a",
    b: str = "score_b",
    label: str = "y",
    names: tuple[str, str] = ("trees", "bayes"),
    decision: float = DECISION,
) -> DataFrame:
    """Rows on which two models differ by more than `threshold`, and which model is right there at `decision`.

    Without any such row all columns but the count are NULL.
    """
    sa, sb, y = F.col(a), F.col(b), F.col(label)
    apart = F.abs(sa - sb) > F.lit(threshold)
    right = lambda s: F.avg(F.when(apart, ((s >= decision).cast("int") == y).cast("double")))
    high, low = F.lit(decision + threshold / 2), F.lit(decision - threshold / 2)
    a_high, b_high = (sa > high) & (sb < low), (sb > high) & (sa < low)
    rate = lambda test: F.coalesce(F.avg(F.when(test, y.cast("double"))), F.lit(0.0))
    row = scored.agg(
        F.sum(apart.cast("long")).alias("n_disagreements"),
        F.count(F.lit(1)).alias("n"),
        right(sa).alias("acc_a"),
        right(sb).alias("acc_b"),
        F.sum(a_high.cast("long")).alias("a_high"),
        F.sum(b_high.cast("long")).alias("b_high"),
        rate(a_high).alias("rate_a"),
        rate(b_high).alias("rate_b"),
    )
    winner = (
        F.when(F.col("acc_a") > F.col("acc_b"), names[0])
        .when(F.col("acc_b") > F.col("acc_a"), names[1])
        .otherwise("tie")
    )
    shown = {
        "disagreement_threshold": F.lit(threshold),
        "disagreement_rate_pct": 100.0 * F.col("n_disagreements") / F.col("n"),
        "accuracy_a": F.col("acc_a"),
        "accuracy_b": F.col("acc_b"),
        "winner": winner,
        "a_high_b_low_count": F.col("a_high"),
        "b_high_a_low_count": F.col("b_high"),
        "fraud_rate_a_high_b_low": F.col("rate_a"),
        "fraud_rate_b_high_a_low": F.col("rate_b"),
    }
    some = F.col("n_disagreements") > 0
    return row.select("n_disagreements", *[F.when(some, v).alias(k) for k, v in shown.items()])


def agreement_grid(scored: DataFrame, cells: int = 20, a: str = "score_a", b: str = "score_b") -> DataFrame:
    """Two-dimensional histogram of both scores with the mean interval width per cell; the last cell is closed."""
    cell = lambda c: F.least(F.floor(F.col(c) * cells), F.lit(cells - 1)).cast("int")
    return scored.groupBy(cell(a).alias("cell_a"), cell(b).alias("cell_b")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(WIDTH).alias("mean_width")
    )


def width_histogram(scored: DataFrame, edges: int = WIDTH_EDGES, label: str = "y") -> DataFrame:
    """Equal-width histogram of the interval width over 0..max, density per class; the last bin is closed."""
    step = F.nullif(scored.agg(F.max(WIDTH)).scalar() / (edges - 1), F.lit(0.0))  # no bins if all widths are 0
    index = F.least(F.floor(F.col(WIDTH) / step), F.lit(edges - 2)).cast("int")
    hist = scored.groupBy(label, index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    in_class = F.sum("n").over(W.partitionBy(label))  # at most `edges` rows per class
    return hist.select(label, "bin", "n", (F.col("n") / (in_class * step)).alias("density"))


def empirical_cdf(
    scored: DataFrame, value: str = WIDTH, label: str = "y", single_task_rows: int | None = None
) -> DataFrame:
    """Distinct values per class with their count and cumulative share."""
    data = scored.where(F.col(value).isNotNull())
    profile = order_profile(data, value, single_task_rows)
    distinct = data.groupBy(label, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(distinct, "value", ["n"], [label], profile=profile)
    return ranked.select(label, "value", "n", (F.col("cum_n") / F.col("total_n")).alias("cdf"))
