import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskframe.operators.split import (
    SplitConfig,
    assert_no_overlap,
    assign_split,
    overlap_violations,
    split_summary,
    time_aware_split,
)


def frame(spark, n):
    return spark.range(n).select(
        F.col("id").alias("TransactionID"),
        (F.col("id") * 7919 % 1000000).alias("TransactionDT"),
        (F.col("id") % 2).cast("int").alias("isFraud"),
    )


def test_config_defaults():
    config = SplitConfig()
    assert (config.train_frac, config.val_frac) == (0.60, 0.20)
    assert config.test_frac == pytest.approx(0.20)


@pytest.mark.parametrize("bad", [{"train_frac": 0.0}, {"val_frac": 1.0}, {"train_frac": 0.8, "val_frac": 0.3}])
def test_config_rejects_bad_fractions(bad):
    with pytest.raises(ValueError):
        SplitConfig(**bad)


def test_sizes_and_order(spark):
    train, val, test = time_aware_split(frame(spark, 100))
    assert [d.count() for d in (train, val, test)] == [60, 20, 20]
    ends = [d.agg(F.min("TransactionDT"), F.max("TransactionDT")).first() for d in (train, val, test)]
    assert ends[0][1] <= ends[1][0] and ends[1][1] <= ends[2][0]


def test_missing_time_column(spark):
    with pytest.raises(KeyError):
        assign_split(frame(spark, 10).drop("TransactionDT"))


@pytest.mark.parametrize("limit", [None, 20])
def test_narrowing_finds_the_same_cuts_as_a_sort(spark, txn_orders, limit):
    """Day-resolution times: the cuts fall inside groups of equal time."""
    tagged = assign_split(txn_orders.drop("split"), single_task_rows=limit)
    ordered = sorted((r["TransactionDT"], r["TransactionID"], r["split"]) for r in tagged.collect())
    n = len(ordered)
    expected = ["train"] * int(n * 0.6) + ["val"] * (int(n * 0.8) - int(n * 0.6))
    assert [s for _, _, s in ordered] == expected + ["test"] * (n - len(expected))


def test_null_times_sort_last(spark):
    df = frame(spark, 20).withColumn("TransactionDT", F.when(F.col("TransactionID") >= 10, F.col("TransactionDT")))
    tagged = {r["TransactionID"]: r["split"] for r in assign_split(df).collect()}
    assert all(tagged[i] == "train" for i in range(10, 20))
    assert [tagged[i] for i in range(10)] == ["train"] * 2 + ["val"] * 4 + ["test"] * 4


def test_clean_splits_pass(spark):
    assert_no_overlap(assign_split(frame(spark, 150)))


@pytest.mark.parametrize("early,late", [("train", "val"), ("val", "test")])
def test_overlap_raises(spark, early, late):
    tagged = assign_split(frame(spark, 150))
    middle = tagged.where(F.col("split") == early).agg(F.median("TransactionDT").cast("long").alias("m")).first()["m"]
    moved = tagged.where((F.col("split") == early) & (F.col("TransactionDT") <= middle)).limit(1)
    bad = tagged.unionByName(moved.withColumn("split", F.lit(late)))
    with pytest.raises(ValueError, match=f"Temporal overlap between {early} and {late}"):
        assert_no_overlap(bad)


def test_equal_boundary_is_no_overlap(spark):
    df = spark.createDataFrame([(1, 5, "train"), (2, 5, "val"), (3, 5, "test")], "TransactionID long, TransactionDT long, split string")
    assert overlap_violations(df).count() == 0


def test_summary_adds_up(spark):
    table = rows(split_summary(assign_split(frame(spark, 200))), "split")
    assert sum(r["n_rows"] for r in table) == 200
    assert sum(r["pct_rows"] for r in table) == pytest.approx(100.0)
