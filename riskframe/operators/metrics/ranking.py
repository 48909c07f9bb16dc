"""Exact ranking metrics from one table of distinct scores.

`score_table` shrinks the data to (model, score, p, n) with map-side combining; everything else is
running totals over it, so cost depends on distinct scores and no task sees a whole model.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskframe.operators.ordering import OrderProfile, order_profile, running_totals
from riskframe.session import materialize

# Points of the KS grid and the floor of the F1 denominator.
KS_GRID = 1_000
F1_FLOOR = 1e-9


def long_scores(scored: DataFrame, scores: Mapping[str, str] | Sequence[str], label: str = "y") -> DataFrame:
    """(model, score, y): one row per input row and model."""
    named = dict(scores) if isinstance(scores, Mapping) else {s: s for s in scores}
    items = [F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score")) for m, c in named.items()]
    return scored.select(F.col(label).cast("long").alias("y"), F.inline(F.array(*items))).where("score IS NOT NULL")


def score_table(long: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return long.groupBy("model", *extra, "score").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))


def ranked_scores(
    scored: DataFrame,
    scores: Mapping[str, str] | Sequence[str],
    label: str = "y",
    single_task_rows: int | None = None,
) -> DataFrame:
    """(model, score, p, n, tp, k, pos, total): descending running totals per model.

    tp / k are the positives / rows at or above the score, pos / total those of the whole model.
    """
    return ranked_long(long_scores(scored, scores, label), single_task_rows)


def ranked_long(long: DataFrame, single_task_rows: int | None = None) -> DataFrame:
    """`ranked_scores` of rows that are already (model, score, y)."""
    return _ranked(score_table(long), order_profile(long, "score", single_task_rows))


def ranked_table(scores: DataFrame, single_task_rows: int | None = None) -> DataFrame:
    """`ranked_scores` of rows (model, score, p, n) that may repeat a score; what gives them runs once."""
    table = materialize(scores.groupBy("model", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")))
    return _ranked(table, order_profile(table, "score", single_task_rows))


def _ranked(table: DataFrame, profile: OrderProfile) -> DataFrame:
    totals = running_totals(table, "score", ["p", "n"], ["model"], descending=True, profile=profile)
    return totals.select(
        "model",
        "score",
        "p",
        "n",
        F.col("cum_p").alias("tp"),
        F.col("cum_n").alias("k"),
        F.col("total_p").alias("pos"),
        F.col("total_n").alias("total"),
    )


def _safe(top: Column, bottom: Column) -> Column:
    return top / F.nullif(bottom, F.lit(0))


def average_precision(ranked: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """PR-AUC: precision at each distinct score weighted by its step in recall, not interpolated."""
    step = F.col("p").cast("double") * F.col("tp") / F.col("k")
    return ranked.groupBy(*by).agg(_safe(F.sum(step), F.sum("p")).alias("pr_auc"))


def _auc() -> Column:
    negatives = F.col("n") - F.col("p")
    wins = negatives * (F.col("tp") - F.col("p") / 2)
    pairs = F.sum("p").cast("double") * F.sum(negatives)  # would overflow a long on large tables
    return _safe(F.sum(wins), pairs)


def roc_auc(ranked: DataFrame) -> DataFrame:
    """Probability that a positive outranks a negative, ties counted half; and the Gini coefficient."""
    return ranked.groupBy("model").agg(_auc().alias("roc_auc")).withColumn("gini", 2 * F.col("roc_auc") - 1)


def _precision() -> Column:
    return F.col("tp") / F.col("k")


def _recall() -> Column:
    return _safe(F.col("tp"), F.col("pos"))


def pr_curve(ranked: DataFrame) -> DataFrame:
    """Precision and recall at every distinct score; `baseline` is the prevalence."""
    return ranked.select(
        "model",
        F.col("score").alias("threshold"),
        _precision().alias("precision"),
        _recall().alias("recall"),
        (F.col("pos") / F.col("total")).alias("baseline"),
    )


def roc_curve(ranked: DataFrame) -> DataFrame:
    false_positives = F.col("k") - F.col("tp")
    return ranked.select(
        "model",
        F.col("score").alias("threshold"),
        _safe(false_positives, F.col("total") - F.col("pos")).alias("fpr"),
        _recall().alias("tpr"),
    )


def f1(precision: Column, recall: Column) -> Column:
    return 2 * precision * recall / F.greatest(precision + recall, F.lit(F1_FLOOR))


def _best() -> Column:
    """Best F1 over the ranked rows; equal values go to the lowest threshold."""
    score = f1(_precision(), _recall())
    return F.max(
        F.struct(
            score.alias("f1"),
            (-F.col("score")).alias("low"),
            _precision().alias("precision"),
            _recall().alias("recall"),
        )
    )


def optimal_threshold(ranked: DataFrame) -> DataFrame:
    """(model, optimal_threshold, f1_at_optimal, precision_at_optimal, recall_at_optimal)."""
    best = ranked.groupBy("model").agg(_best().alias("b"))
    return best.select(
        "model",
        (-F.col("b.low")).alias("optimal_threshold"),
        F.col("b.f1").alias("f1_at_optimal"),
        F.col("b.precision").alias("precision_at_optimal"),
        F.col("b.recall").alias("recall_at_optimal"),
    )


def threshold_metrics(scored: DataFrame, scores: Mapping[str, str] | Sequence[str], threshold: float = 0.5,
                      label: str = "y") -> DataFrame:
    """Precision, recall and F1 of `score >= threshold`; a zero denominator gives 0."""
    called = F.col("score") >= F.lit(threshold)
    counts = long_scores(scored, scores, label).groupBy("model").agg(
        F.sum(F.when(called, F.col("y")).otherwise(0)).alias("tp"),
        F.sum(called.cast("long")).alias("k"),
        F.sum("y").alias("pos"),
    )
    return counts.select("model", *_at_threshold())


def _at_threshold(tp: str = "tp", k: str = "k", pos: str = "pos") -> list[Column]:
    t, n, p = F.col(tp), F.col(k), F.col(pos)
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    return [
        zero(_safe(t, n)).alias("precision_at_50"),
        zero(_safe(t, p)).alias("recall_at_50"),
        zero(_safe(2.0 * t, n + p)).alias("f1_at_50"),
    ]


def ks_statistic(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Largest gap of the class-wise score distributions on an even grid over [0, 1].

    Input: a score table. Each score falls on the first grid point that is not below it, which leaves a
    histogram of at most 1000 rows per model to accumulate.
    """
    last = KS_GRID - 1
    point = lambda i: F.when(i >= last, F.lit(1.0)).otherwise(i * F.lit(1.0 / last))
    guess = F.ceil(F.col("score") * last)
    index = (
        F.when(point(guess) < F.col("score"), guess + 1)
        .when(point(guess - 1) >= F.col("score"), guess - 1)
        .otherwise(guess)
    )
    hist = scores.groupBy(*by, F.greatest(index, F.lit(0)).alias("i")).agg(
        F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q")
    )
    side = W.partitionBy(*by)
    upto = side.orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    share = lambda c: _safe(F.sum(c).over(upto), F.sum(c).over(side))
    gap = share("p") - share("q")
    # above 1 there is no grid point; those scores only count in the class sizes
    gaps = hist.select(*by, "i", F.abs(gap).alias("gap")).withColumn("gap", F.when(F.col("i") <= last, F.col("gap")))
    return gaps.groupBy(*by).agg(F.max("gap").alias("ks_statistic"))
