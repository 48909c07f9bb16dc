"""The distributed paths (tiny `single_task_rows`) against the single-task ones and against Python."""

import pytest
from conftest import rows, same
from pyspark.sql import functions as F

from riskframe.operators import ordering
from riskframe.operators.ordering import dense_codes, exact_quantiles, kth_keys, order_profile, running_totals
from riskframe.operators.sampling import sample_exact
from riskframe.operators.split import assign_split

PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.fixture(scope="module")
def values(spark):
    """A heavy tail, many ties, and one value that holds a third of all rows."""
    return spark.sql(
        """SELECT id, CASE WHEN id % 3 = 0 THEN 7.5 ELSE round(pow(id * 7919 % 1009, 1.7) / 3, 1) END AS v,
             CAST(id % 2 AS INT) AS side FROM range(3000)"""
    ).cache()


def test_profile_counts_values(values):
    holes = values.withColumn("v", F.when(F.col("id") % 5 != 0, F.col("v")))
    assert order_profile(values, "v").small and not order_profile(values, "v", 100).small
    assert order_profile(holes, "v", 100).rows == 2400


@pytest.mark.parametrize("kind", ["double", "string"])
def test_no_part_is_above_the_bound(spark, monkeypatch, kind):
    """Parts are cut again until they fit, whatever the type of the value; totals stay exact through several levels."""
    monkeypatch.setattr(ordering, "MAX_BUCKETS", 4)
    value = {"double": F.pow(F.col("id").cast("double"), F.lit(3.0)), "string": F.md5(F.col("id").cast("string")), "date": F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int"))}[kind]
    df = spark.range(200).select(value.alias("v"), (F.col("id") % 3).alias("side"), F.col("id").alias("n"))
    parts, sizes = ordering.ordered_parts(df, "v", ["side"], 10)
    assert sizes.agg(F.max("__rows")).first()[0] <= 10
    assert parts.agg(F.max(F.size("__part"))).first()[0] >= 2
    ends = parts.groupBy("side", "__part").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("side", "__part").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(ends, ends[1:]) if a["side"] == b["side"])
    groups = []
    window = ordering.W.partitionBy
    monkeypatch.setattr(ordering.W, "partitionBy", lambda *keys: groups.append(keys) or window(*keys))
    cut = running_totals(df, "v", ["n"], ["side"], True, ordering.OrderProfile(200, 10))
    assert set(groups) <= {("side", "__part"), ("side",)}  # a window over a side alone holds at most ten parts' totals
    same(cut, running_totals(df, "v", ["n"], ["side"], True), "side", "v")


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("by", [[], ["side"]])
def test_running_totals(values, descending, by):
    distinct = values.groupBy(*by, "v").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    whole = running_totals(distinct, "v", ["n", "s"], by, descending)
    cut = running_totals(distinct, "v", ["n", "s"], by, descending, order_profile(values, "v", 50))
    same(cut, whole, *by, "v")


@pytest.mark.parametrize("by", [[], ["side"]])
def test_quantiles(values, by):
    small = exact_quantiles(values, "v", PROBS, by)
    large = exact_quantiles(values, "v", PROBS, by, single_task_rows=50)
    for a, b in zip(rows(small, *by), rows(large, *by)):
        assert b["q"] == pytest.approx(a["q"])


def test_quantiles_skip_nulls(values):
    holes = values.withColumn("v", F.when(F.col("id") % 5 != 0, F.col("v")))
    a, b = exact_quantiles(holes, "v", [0.5]).first(), exact_quantiles(holes, "v", [0.5], single_task_rows=50).first()
    assert a["q"] == pytest.approx(b["q"])


def test_kth_keys(values):
    ordered = sorted((r["v"], r["id"]) for r in values.collect())
    ks = [0, 1, 999, 1000, 1500, 2998, 2999]
    assert kth_keys(values, ["v", "id"], ks) == [ordered[k] for k in ks]
    assert kth_keys(values, ["v", "id"], ks, single_task_rows=40) == [ordered[k] for k in ks]


@pytest.mark.parametrize("limit", [None, 7, 40])
def test_kth_keys_of_any_type(spark, limit):
    """Text, repeated rows and NULLs in every column: NULLs last, on both sides of the bound."""
    rows_ = [(None if i % 13 == 0 else float(i % 29), None if i % 7 == 0 else f"id{i * 31 % 97:03d}") for i in range(600)]
    rows_ += [(5.0, "id005")] * 200  # a quarter of the rows are one key
    df = spark.createDataFrame(rows_, "t double, i string")
    last = lambda v: (v is None, v if v is not None else 0)
    ordered = sorted(rows_, key=lambda r: (last(r[0]), (r[1] is None, r[1] or "")))
    ks = [0, 3, 150, 300, 301, 500, 640, 798, 799]
    assert kth_keys(df, ["t", "i"], ks, single_task_rows=limit) == [ordered[k] for k in ks]
    assert kth_keys(df, ["t", "i"], [], single_task_rows=limit) == []


def test_all_ranks_share_the_passes(spark, values, monkeypatch):
    """The number of jobs that bring rows to the driver does not grow with the ranks."""
    kind = type(values)
    calls = []
    for name in ("collect", "first", "count"):
        monkeypatch.setattr(kind, name, lambda self, *a, f=getattr(kind, name): calls.append(name) or f(self, *a))
    needed = []
    for ks in ([1500], list(range(0, 3000, 250))):
        calls.clear()
        kth_keys(values, ["v", "id"], ks, single_task_rows=400)
        needed.append(len(calls))
    assert needed[1] <= needed[0] + 3


@pytest.mark.parametrize("n", [10, 57, 60])
def test_samples_are_the_same_on_both_sides_of_the_bound(spark, n):
    """NULL and repeated ids: a top-k and a cut give the same rows, exactly n of them."""
    df = spark.createDataFrame([(None if i % 20 == 0 else f"x{i // 2}", i) for i in range(60)], "TransactionID string, v int")
    top = sample_exact(df, n, top_k_rows=1000)
    assert top.count() == n
    for limit in (None, 5):
        cut = sample_exact(df, n, top_k_rows=0, single_task_rows=limit)
        assert sorted(r["v"] for r in cut.collect()) == sorted(r["v"] for r in top.collect())
    assert top.where("TransactionID IS NULL").count() == max(0, n - 57)
    copies = spark.createDataFrame([("a", 1)] * 30 + [("b", 2)] * 30, "TransactionID string, v int")
    assert sample_exact(copies, 41, top_k_rows=0, single_task_rows=5).count() == 41


@pytest.mark.parametrize("limit", [None, 20])
def test_text_ids_are_split(spark, limit):
    df = spark.range(200).select(
        F.when(F.col("id") % 9 != 0, F.md5(F.col("id").cast("string"))).alias("TransactionID"),
        F.when(F.col("id") % 4 != 0, F.col("id") % 5).alias("TransactionDT"), F.lit(0).alias("isFraud"),
    )
    tagged = assign_split(df, single_task_rows=limit)
    sizes = {r["split"]: r["count"] for r in tagged.groupBy("split").count().collect()}
    ordered = sorted(((r[1] is None, r[1] or 0), (r[0] is None, r[0] or ""), r["split"]) for r in tagged.collect())
    names = [s for *_, s in ordered]
    assert names == sorted(names, key=["train", "val", "test"].index) and sizes["train"] <= 120


def test_codes_of_strings(spark):
    words = spark.sql(
        "SELECT concat('col', id % 2) AS column, md5(CAST(id AS STRING)) AS value FROM range(500)"
    )
    same(
        dense_codes(words, "column", "value", "code", single_task_rows=10),
        dense_codes(words, "column", "value", "code"),
        "column",
        "value",
    )
