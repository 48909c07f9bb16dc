import math

import pytest
from conftest import SF, rows, same
from pyspark.sql import functions as F

from riskframe import fixtures
from riskframe.operators import blocks, encoders, joins
from riskframe.operators.split import assign_split, time_aware_split
from riskframe.plans.features import FeaturePipeline, PipelineConfig, build_features


def test_temporal_columns_and_ranges(transactions):
    out = blocks.compute_temporal_features(transactions)
    assert {"hour_of_day", "day_of_week", "is_night", "is_weekend", "day_of_dataset"} <= set(out.columns)
    for r in out.collect():
        assert 0 <= r["hour_of_day"] <= 23 and 0 <= r["day_of_week"] <= 6


def test_negative_times_floor(spark):
    df = spark.createDataFrame([(-1,)], "TransactionDT long")
    row = blocks.compute_temporal_features(df).first()
    assert (row["hour_of_day"], row["day_of_week"], row["day_of_dataset"]) == (23, 6, -1)


def test_required_columns(transactions):
    with pytest.raises(KeyError):
        blocks.compute_temporal_features(transactions.drop("TransactionDT"))
    with pytest.raises(KeyError):
        blocks.compute_amount_features(transactions.drop("TransactionAmt"))
    with pytest.raises(KeyError):
        encoders.compute_spend_spike_features(
            transactions.drop("TransactionAmt"), encoders.fit_amount_encoders(transactions)
        )


def test_amount_features(spark, transactions):
    for r in blocks.compute_amount_features(transactions).collect():
        assert r["log1p_amt"] >= 0 and 0.0 <= r["amt_cents"] <= 1.0
    df = spark.createDataFrame([(20.0,), (20.5,), (0.999,)], "TransactionAmt double")
    got = [(r["amt_cents"], r["is_round_amount"]) for r in blocks.compute_amount_features(df).collect()]
    assert got == [(0.0, 1), (0.5, 0), (1.0, 0)]


def test_narrow_outputs(transactions):
    out = blocks.compute_amount_features(blocks.compute_temporal_features(transactions, narrow=True), narrow=True)
    types = dict(out.dtypes)
    assert (types["hour_of_day"], types["day_of_dataset"], types["log1p_amt"]) == ("tinyint", "smallint", "float")


def test_encoder_keys(transactions):
    fitted = encoders.fit_amount_encoders(transactions)
    assert "card1_mean" in fitted and "addr1_mean" in fitted and "_global_mean" in fitted


def test_zscores_are_clipped(transactions):
    out = encoders.compute_spend_spike_features(transactions, encoders.fit_amount_encoders(transactions))
    for name in [c for c in out.columns if "zscore" in c]:
        low, high = out.agg(F.min(name), F.max(name)).first()
        assert -5 <= low and high <= 5


def test_unseen_entity_uses_the_global_pair(spark):
    train = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 30.0)], "card1 long, TransactionAmt double")
    fitted = encoders.fit_amount_encoders(train, ["card1"])
    row = encoders.compute_spend_spike_features(
        spark.createDataFrame([(9, 40.0)], "card1 long, TransactionAmt double"), fitted, ["card1"]
    ).first()
    assert row["amt_to_card1_mean_ratio"] == pytest.approx(2.0)
    assert row["amt_zscore_card1"] == pytest.approx(2.0)
    single = {r["card1"]: r["std"] for r in fitted.tables["card1"].table.collect()}
    assert single[2] == 0.0


def test_lookup_join_paths_agree(spark, txn):
    """Broadcast and salted shuffle give the same rows, with a hot key and NULL keys."""
    fitted = encoders.fit_amount_encoders(txn, ["P_emaildomain", "card1"])
    for entity in ("P_emaildomain", "card1"):
        wanted = {"m": F.col("mean"), "s": F.col("std")}
        small = joins.lookup_join(txn, fitted.tables[entity], wanted).select("TransactionID", "m", "s")
        large = joins.lookup_join(txn, fitted.tables[entity], wanted, broadcast_rows=0).select("TransactionID", "m", "s")
        same(large, small, "TransactionID")
        assert large.count() == txn.count()


def test_address_mode_ties_and_nulls(spark):
    train = spark.createDataFrame(
        [(1, 7, None), (1, 5, None), (1, None, None), (2, 3, "b"), (2, 3, "a"), (2, 4, "b")],
        "card1 long, addr1 long, addr2 string",
    )
    fitted = encoders.fit_address_encoders(train)
    table = {r["card1"]: r.asDict() for r in fitted.table.table.collect()}
    assert table[1]["addr1_mode"] == 5 and table[1]["addr1_n_unique"] == 2
    assert table[1]["addr2_mode"] is None and table[1]["addr2_n_unique"] == 0
    assert table[2]["addr1_mode"] == 3 and table[2]["addr2_mode"] == "b"
    new = spark.createDataFrame([(1, 5, "z"), (1, None, None), (9, 5, "b")], train.schema)
    got = encoders.compute_address_features(new, fitted).collect()
    assert [r["card1_addr1_is_mode"] for r in got] == [1, 0, 0]
    assert [r["card1_addr1_n_unique"] for r in got] == [2, 2, 1]
    assert [r["card1_addr2_n_unique"] for r in got] == [0, 0, 1]


def test_email_rules(spark):
    df = spark.createDataFrame(
        [("Gmail.com", "gmail.com"), (None, None), ("corp.example", None), ("nan.org", "163.com")],
        "P_emaildomain string, R_emaildomain string",
    )
    got = blocks.compute_email_features(df).collect()
    assert [r["email_match"] for r in got] == [1, 0, 0, 0]
    assert [r["p_email_tld"] for r in got] == ["gmail", "unknown", "corp", "nan"]
    assert [r["email_tld_match"] for r in got] == [1, 1, 0, 0]
    assert [r["both_free_email"] for r in got] == [1, 0, 0, 0]


def test_absent_email_columns_never_match(spark):
    row = blocks.compute_email_features(spark.range(1)).first()
    assert row["email_match"] == 0 and row["p_email_tld"] == "unknown"


def test_identity_presence(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "id_01 int, DeviceType string")
    got = blocks.compute_identity_presence_features(df).collect()
    assert [(r["has_identity"], r["identity_completeness"]) for r in got] == [(1, 0.5), (0, 0.0)]
    bare = blocks.compute_identity_presence_features(spark.range(1)).first()
    assert (bare["has_identity"], bare["identity_completeness"]) == (0, 0.0)


def test_plan_adds_54_features_and_keeps_rows(spark, txn):
    merged = joins.merge_tables(txn, fixtures.identity(spark, SF))
    with pytest.raises(RuntimeError):
        FeaturePipeline().transform(merged)
    train, val, test = time_aware_split(merged)
    plan = FeaturePipeline()
    parts = plan.fit_transform_splits(train, val, test)
    assert len(plan.feature_names_) == 54
    assert [p.count() for p in parts] == [train.count(), val.count(), test.count()]
    assert set(merged.columns) <= set(parts[0].columns)
    flags = plan.validate(parts[0]).where("all_null").count()
    assert flags == 0


def test_encoders_ignore_later_rows(spark, txn):
    train, val, _ = time_aware_split(txn)
    base = build_features(val, train_df=train, config=PipelineConfig(run_velocity=False))
    changed = val.withColumn("TransactionAmt", F.when(F.col("TransactionID") % 2 == 0, 1e6).otherwise(F.col("TransactionAmt")))
    other = build_features(changed, train_df=train, config=PipelineConfig(run_velocity=False))
    odd = lambda d: d.where("TransactionID % 2 = 1").select("TransactionID", "amt_zscore_card1", "card1_addr1_is_mode")
    same(odd(base), odd(other), "TransactionID")


def test_one_pass_over_splits_equals_split_by_split(txn):
    tagged = assign_split(txn)
    config = PipelineConfig(velocity_within=["split"])
    names = ["TransactionID", "vel_card1_7d_count", "vel_addr1_24h_sum", "amt_zscore_addr1"]
    plan = FeaturePipeline(config).fit(tagged.where("split = 'train'"))
    whole = plan.transform(tagged).select(*names)
    parts = time_aware_split(txn)
    separate = FeaturePipeline().fit_transform_splits(*parts)
    same(whole, separate[0].unionByName(separate[1]).unionByName(separate[2]).select(*names), "TransactionID")


def test_blocks_can_be_switched_off(txn):
    out = build_features(txn, config=PipelineConfig(run_velocity=False, run_identity=False))
    assert "hour_of_day" in out.columns and "email_match" not in out.columns
    assert not any(c.startswith("vel_") for c in out.columns)


def test_log1p_value(spark):
    row = blocks.compute_amount_features(spark.createDataFrame([(99.0,)], "TransactionAmt double")).first()
    assert row["log1p_amt"] == pytest.approx(math.log(100.0))
    assert rows(spark.range(2), "id") == [{"id": 0}, {"id": 1}]
