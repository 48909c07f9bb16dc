import pytest
from conftest import rows, same
from pyspark.sql import functions as F

from riskframe.operators.velocity import compute_velocity_features, expected_feature_names

HOUR = {"1h": 3600}


@pytest.fixture
def five(spark):
    return spark.createDataFrame(
        [
            (1, 0, 100.0, "A", "X", "g.com"),
            (2, 1800, 200.0, "A", "X", "g.com"),
            (3, 3700, 50.0, "A", "Y", "y.com"),
            (4, 90000, 300.0, "B", "X", "g.com"),
            (5, 90100, 75.0, "B", "Y", "y.com"),
        ],
        "TransactionID long, TransactionDT long, TransactionAmt double, card1 string, addr1 string, P_emaildomain string",
    )


def test_names(five):
    out = compute_velocity_features(five, ["card1"], HOUR)
    assert out.columns[-3:] == ["vel_card1_1h_count", "vel_card1_1h_sum", "vel_card1_1h_mean_amt"]
    assert expected_feature_names(["card1"], HOUR) == out.columns[-3:]


def test_27_columns(five):
    assert len([c for c in compute_velocity_features(five).columns if c.startswith("vel_")]) == 27


@pytest.mark.parametrize("method", ["prefix", "sliding", "chunked", "auto"])
def test_window_is_left_closed_right_open(five, method):
    got = rows(compute_velocity_features(five, ["card1"], HOUR, method=method), "TransactionID")
    assert [r["vel_card1_1h_count"] for r in got] == [0, 1, 1, 0, 1]
    assert [r["vel_card1_1h_sum"] for r in got] == [0, 100, 200, 0, 300]
    assert [r["vel_card1_1h_mean_amt"] for r in got] == [0, 100, 200, 0, 300]


def test_null_entity_is_one_group(five):
    nulled = five.withColumn("card1", F.when(F.col("TransactionID") > 2, F.col("card1")))
    got = rows(compute_velocity_features(nulled, ["card1"], HOUR), "TransactionID")
    assert [r["vel_card1_1h_count"] for r in got] == [0, 1, 0, 0, 1]


def test_rows_of_one_second_do_not_see_each_other(five):
    tied = five.withColumn("TransactionDT", F.lit(500))
    for method in ("prefix", "chunked"):
        out = compute_velocity_features(tied, ["addr1"], HOUR, method=method)
        assert out.agg(F.sum("vel_addr1_1h_count")).first()[0] == 0


def test_null_amount_is_not_counted(five):
    hole = five.withColumn("TransactionAmt", F.when(F.col("TransactionID") != 1, F.col("TransactionAmt")))
    for method in ("prefix", "sliding", "chunked"):
        got = rows(compute_velocity_features(hole, ["card1"], HOUR, method=method), "TransactionID")
        assert [r["vel_card1_1h_count"] for r in got] == [0, 0, 1, 0, 1]


@pytest.mark.parametrize("method", ["prefix", "chunked"])
@pytest.mark.parametrize("scale", [None, 2])
def test_methods_agree_with_sliding_frames(txn, method, scale):
    plain = compute_velocity_features(txn, method="sliding")
    other = compute_velocity_features(txn, method=method, amount_scale=scale)
    names = ["TransactionID", *expected_feature_names()]
    same(other.select(*names), plain.select(*names), "TransactionID")


def test_methods_agree_on_tied_times(txn_orders):
    entities = ["addr1", "addr2"]
    names = ["TransactionID", *expected_feature_names(entities)]
    plain = compute_velocity_features(txn_orders, entities, method="sliding").select(*names)
    same(compute_velocity_features(txn_orders, entities, method="chunked").select(*names), plain, "TransactionID")


def test_auto_cuts_hot_entities(txn):
    small = compute_velocity_features(txn, ["addr1"], hot_entity_rows=10)
    plan = small._jdf.queryExecution().toString()
    assert "__chunk" in plan
    names = ["TransactionID", *expected_feature_names(["addr1"])]
    same(small.select(*names), compute_velocity_features(txn, ["addr1"], method="sliding").select(*names), "TransactionID")


@pytest.mark.parametrize("method", ["prefix", "chunked"])
def test_history_equals_one_table(txn, method):
    cut = 15 * 86400
    past, later = txn.where(F.col("TransactionDT") < cut), txn.where(F.col("TransactionDT") >= cut)
    names = ["TransactionID", *expected_feature_names(["card1"])]
    got = compute_velocity_features(later, ["card1"], method=method, history=past).select(*names)
    whole = compute_velocity_features(txn, ["card1"]).where(F.col("TransactionDT") >= cut).select(*names)
    same(got, whole, "TransactionID")


@pytest.mark.parametrize("method", ["prefix", "chunked"])
def test_within_separates_groups(txn, method):
    tagged = txn.withColumn("side", F.col("TransactionID") % 2)
    names = ["TransactionID", *expected_feature_names(["card1"])]
    got = compute_velocity_features(tagged, ["card1"], method=method, within=["side"]).select(*names)
    halves = [compute_velocity_features(tagged.where(F.col("side") == s), ["card1"]).select(*names) for s in (0, 1)]
    same(got, halves[0].unionByName(halves[1]), "TransactionID")


def test_join_back_gives_the_same_features(txn):
    names = ["TransactionID", "ProductCD", *expected_feature_names()]
    got = compute_velocity_features(txn, join_on="TransactionID").select(*names)
    same(got, compute_velocity_features(txn).select(*names), "TransactionID")


def test_prefix_needs_one_exchange_per_entity(txn):
    plan = compute_velocity_features(txn, method="prefix")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3


def test_missing_columns(five):
    with pytest.raises(KeyError):
        compute_velocity_features(five.drop("TransactionAmt"))
    assert len(compute_velocity_features(five.drop("addr1")).columns) == 5 + 18
    with pytest.raises(ValueError):
        compute_velocity_features(five, method="other")


def test_auto_measures_each_entity_with_its_group(txn):
    """The mail domain has large groups, the card small ones; only the former is cut."""
    from riskframe.operators.velocity import _choose

    tagged = txn.withColumn("side", F.col("TransactionID") % 2)
    biggest = lambda e: tagged.groupBy("side", e).count().agg(F.max("count")).first()[0]
    limit = biggest("card1")
    assert limit < biggest("P_emaildomain")
    got = _choose(tagged, None, ["card1", "P_emaildomain"], ["side"], "auto", limit)
    assert got == {"card1": "prefix", "P_emaildomain": "chunked"}
    assert _choose(tagged, tagged, ["card1"], ["side"], "auto", limit) == {"card1": "chunked"}


def test_chunked_entities_do_not_recompute_each_other(txn):
    plan = compute_velocity_features(txn, method="chunked")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 3


def test_all_methods_agree_on_odd_amounts_and_times(spark):
    rows = [(1, 0, 1e15, "a"), (2, 10, 5.03, "a"), (3, 20, float("nan"), "a"), (4, 4000, 1.07, "a"), (5, None, 5.0, "a"), (6, 4010, 2.125, "a"),
            (7, None, 7.0, "a"), (8, 4020, float("inf"), None), (9, 4030, 1.001, None), (10, 4040, 0.002, None)]
    df = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, TransactionAmt double, card1 string")
    names = ["TransactionID", *expected_feature_names(["card1"])]
    made = {m: compute_velocity_features(df, ["card1"], method=m).select(*names) for m in ("sliding", "prefix", "chunked")}
    wanted = sorted(map(str, made["sliding"].collect()))
    assert sorted(map(str, made["prefix"].collect())) == wanted
    assert sorted(map(str, made["chunked"].collect())) == wanted
    by_id = {r["TransactionID"]: r for r in made["prefix"].collect()}
    assert by_id[6]["vel_card1_1h_sum"] == 1.07 and by_id[6]["vel_card1_1h_count"] == 1
    assert by_id[5]["vel_card1_7d_count"] == 0 and by_id[10]["vel_card1_1h_sum"] == 1.001
    twice = compute_velocity_features(compute_velocity_features(df, ["card1"]), ["card1"])
    assert sorted(map(str, twice.select(*names).collect())) == wanted


def _odd_rows(spark):
    """Repeated ids, NULL and NaN entities, signed zeros, ties and a row without time."""
    made = [(i % 40, (i * 37) % 300, float(i % 9), [None, float("nan"), 0.0, -0.0, 1.5][i % 5], ["a", None, "NULL"][i % 3]) for i in range(200)]
    return spark.createDataFrame([*made, (7, None, 1.0, 0.0, "a"), made[3]], "TransactionID long, TransactionDT long, TransactionAmt double, u double, v string")


@pytest.mark.parametrize("method, hot", [("prefix", 10**6), ("sliding", 10**6), ("auto", 20), ("chunked", 1)])
def test_all_entities_in_one_exchange_give_the_same(spark, method, hot):
    df, windows = _odd_rows(spark), {"s": 10, "l": 100}
    options = dict(entity_cols=["u", "v"], windows=windows, history=df.where("TransactionID < 5"), hot_entity_rows=hot)
    plain = compute_velocity_features(df, method="sliding", **options)
    joined = compute_velocity_features(df, method=method, join_on="TransactionID", **options)
    assert joined.columns == plain.columns
    assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))


def test_wide_rows_are_shuffled_by_their_id_only(spark, txn):
    wide = txn.withColumn("__payload", F.lit("x"))
    plan = compute_velocity_features(wide, join_on="TransactionID", method="prefix")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Generate inline") == 1
    assert "__payload" not in plan.split("Aggregate")[-1]
