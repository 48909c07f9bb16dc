import numpy as np
import pytest
from conftest import rows, same
from pyspark.sql import functions as F

from riskframe.operators.metrics import calibration, ranking, report
from riskframe.operators.metrics import uncertainty as u


def scores(spark, pairs):
    return spark.createDataFrame([(float(s), int(y)) for s, y in pairs], "s double, y int")


def brute_force(pairs):
    """Definitions over all thresholds and all pairs, in plain Python."""
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    ap, before, best = 0.0, 0.0, (-1.0, 0.0)
    for t in sorted({s for s, _ in pairs}, reverse=True):
        tp, k = sum(s >= t for s in pos), sum(s >= t for s, _ in pairs)
        p, r = tp / k, tp / len(pos)
        ap, before = ap + (r - before) * p, r
        f = 2 * p * r / max(p + r, 1e-9)
        best = max(best, (f, -t))
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    grid = np.linspace(0, 1, 1000)
    gap = lambda vals: np.searchsorted(np.sort(vals), grid, side="right") / len(vals)
    ks = np.max(np.abs(gap(pos) - gap(neg)))
    edges, ece = np.linspace(0, 1, 11), 0.0
    for lo, hi in zip(edges[:-1], edges[1:]):
        inside = [(s, y) for s, y in pairs if lo <= s < hi]
        if inside:
            s, y = np.mean([a for a, _ in inside]), np.mean([b for _, b in inside])
            ece += len(inside) / len(pairs) * abs(s - y)
    brier = np.mean([(s - y) ** 2 for s, y in pairs])
    return {"pr_auc": ap, "roc_auc": auc, "ks_statistic": ks, "ece": ece, "brier_score": brier,
            "f1_at_optimal": best[0], "optimal_threshold": -best[1]}


RNG = np.random.default_rng(5)
CASES = {
    "tied": [(s / 20, y) for s, y in zip(RNG.integers(0, 21, 300), RNG.integers(0, 2, 300))],
    "edges": [(e, i % 2) for i, e in enumerate(calibration.EDGES)] + [(i / 999, i % 3 == 0) for i in range(0, 1000, 37)],
    "continuous": [(s, y) for s, y in zip(RNG.random(200), RNG.integers(0, 2, 200))],
}


@pytest.mark.parametrize("name", CASES)
def test_matrix_matches_definitions(spark, name):
    got = report.metrics_matrix(scores(spark, CASES[name]), {"m": "s"}, rounded=False).first().asDict()
    for key, value in brute_force(CASES[name]).items():
        assert got[key] == pytest.approx(value, abs=1e-12), key
    assert got["gini"] == pytest.approx(2 * got["roc_auc"] - 1)


@pytest.mark.parametrize("name", CASES)
def test_bucketed_ranking_is_the_same(spark, name):
    df = scores(spark, CASES[name])
    same(ranking.ranked_scores(df, ["s"], single_task_rows=20), ranking.ranked_scores(df, ["s"]), "score")


def test_perfect_and_constant_scores(spark):
    perfect = report.metrics_matrix(scores(spark, [(0.9, 1), (0.8, 1), (0.1, 0), (0.2, 0)]), {"m": "s"}).first()
    assert perfect["pr_auc"] == perfect["roc_auc"] == perfect["ks_statistic"] == perfect["f1_at_optimal"] == 1.0
    flat = report.metrics_matrix(scores(spark, [(0.5, 1), (0.5, 0), (0.5, 0), (0.5, 0)]), {"m": "s"}).first()
    assert (flat["pr_auc"], flat["roc_auc"], flat["ks_statistic"]) == (0.25, 0.5, 0.0)


def test_zero_denominators_give_zero(spark):
    row = ranking.threshold_metrics(scores(spark, [(0.1, 1), (0.2, 0)]), ["s"]).first()
    assert (row["precision_at_50"], row["recall_at_50"], row["f1_at_50"]) == (0.0, 0.0, 0.0)


def test_bin_edges(spark):
    df = scores(spark, [(e, 0) for e in calibration.EDGES])
    got = df.select(calibration.ece_bin(F.col("s")).alias("a"), calibration.reliability_bin(F.col("s")).alias("b"))
    assert [r["a"] for r in got.collect()] == [*range(10), None]
    assert [r["b"] for r in got.collect()] == [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]


def test_equal_f1_takes_the_lowest_threshold(spark):
    row = ranking.optimal_threshold(ranking.ranked_scores(scores(spark, [(0.9, 1), (0.6, 0), (0.3, 1)]), ["s"])).first()
    assert row["optimal_threshold"] == pytest.approx(0.3)


def test_published_arithmetic():
    """Internal arithmetic of published results: gini = 2 AUC - 1, miss rate and recovery."""
    assert 2 * 0.869896 - 1 == pytest.approx(0.739793, abs=1.1e-6)
    assert round(100 * 2602 / 4064, 2) == pytest.approx(64.03, abs=0.011)


def review(spark):
    return spark.createDataFrame(
        [(1, 0.9, 0.2, 0.4), (1, 0.1, 0.8, 0.9), (0, 0.2, 0.3, 0.1), (0, 0.3, 0.35, 0.2), (0, 0.7, 0.1, 0.3)],
        "y int, score_a double, score_b double, hdi_width double",
    ).withColumn("std", F.col("hdi_width") / 4)


def test_review_queues(spark):
    summary, table = u.review_queues(review(spark), [0.5, 0.75])
    row = summary.first()
    assert row["optimal_threshold"] == pytest.approx(0.9)
    assert row["total_false_negatives"] == 1 and row["fn_miss_rate_pct"] == 50.0
    got = rows(table, "uncertainty_percentile")
    assert [r["review_queue_size"] for r in got] == [3, 2]
    assert [r["fn_recovery_pct"] for r in got] == [100.0, 100.0]
    assert row["headline_queue_size_pct"] == got[1]["review_queue_pct_all"]


def test_headline_falls_back_to_the_last_queue(spark):
    summary, table = u.review_queues(review(spark), [0.5, 0.6])
    assert summary.first()["headline_queue_size_pct"] == rows(table, "uncertainty_percentile")[-1]["review_queue_pct_all"]


def test_disagreement(spark):
    row = u.disagreement(review(spark)).first()
    assert row["n_disagreements"] == 3
    assert row["accuracy_a"] == pytest.approx(1 / 3) and row["accuracy_b"] == pytest.approx(2 / 3)
    assert row["winner"] == "bayes" and row["a_high_b_low_count"] == 2 and row["b_high_a_low_count"] == 1


def test_no_disagreement_gives_only_the_count(spark):
    row = u.disagreement(review(spark), threshold=2.0).first().asDict()
    assert row.pop("n_disagreements") == 0
    assert set(row.values()) == {None}


def test_routing(spark):
    got = [r["decision"] for r in u.route_decisions(review(spark)).collect()]
    assert got == ["review", "review", "approve", "approve", "approve"]


def test_empirical_cdf_ends_at_one(scored):
    whole = u.empirical_cdf(scored)
    assert whole.groupBy("y").agg(F.max("cdf").alias("top")).where("top <> 1").count() == 0
    same(u.empirical_cdf(scored, single_task_rows=50), whole, "y", "value")


def test_width_histogram_integrates_to_one(scored):
    step = scored.agg(F.max("hdi_width")).first()[0] / 59
    total = u.width_histogram(scored).groupBy("y").agg((F.sum("density") * step).alias("area")).collect()
    assert [r["area"] for r in total] == pytest.approx([1.0, 1.0])


def test_one_class_or_no_rows_give_nulls_not_errors(spark):
    row = report.metrics_matrix(scores(spark, [(0.4, 0), (0.2, 0)]), {"m": "s"}).first()
    assert row["roc_auc"] is None and row["pr_auc"] is None and row["ks_statistic"] is None
    assert row["brier_score"] == pytest.approx(0.1)
    empty = review(spark).where("y > 1")
    assert u.review_queues(empty)[0].first()["fn_miss_rate_pct"] is None
    assert u.disagreement(empty).first()["n_disagreements"] in (None, 0)
    flat = review(spark).withColumn("hdi_width", F.lit(0.0))
    assert u.width_histogram(flat).agg(F.sum("n")).first()[0] == 5


def test_shares_of_nothing_are_null(spark):
    from riskframe.operators.profile import rank_by

    df = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "feature string, importance double")
    assert [r["importance_pct"] for r in rank_by(df, "feature", "importance").collect()] == [None, None]
