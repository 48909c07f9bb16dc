"""Sources, narrowing, coding, sampling and profiling."""

import pytest
from conftest import SF, rows, same
from pyspark.sql import functions as F

from riskframe import fixtures, session
from riskframe.operators import coding, joins, profile, sampling
from riskframe.operators.split import time_aware_split
from riskframe.sources import narrowing, sinks, tables


def test_splits_round_trip(spark, txn, tmp_path):
    parts = time_aware_split(txn)
    for fmt in ("parquet", "csv"):
        paths = tables.save_splits(*parts, str(tmp_path / fmt), fmt)
        assert set(paths) == {"train", "val", "test"}
        for before, after in zip(parts, tables.load_splits(spark, str(tmp_path / fmt), fmt)):
            same(after.select("TransactionID", "TransactionAmt"), before, "TransactionID")


def test_csv_splits_come_back_by_their_schema(spark, tmp_path):
    schema = "id long, zip string, note string, gone double, flag boolean, small float, day date, at timestamp, amount decimal(12,2)"
    day = F.expr("date '2024-02-29'"), F.expr("timestamp '2024-02-29 01:02:03.000004'")
    made = [(1, "007", ' a "b", c ', None, True, 0.1, "1.50"), (2, "", "two\nlines", None, None, None, None), (3, None, "\\", None, False, 1e-7, "0.10")]
    rows = spark.createDataFrame(made, "id long, zip string, note string, gone double, flag boolean, small float, amount string")
    rows = rows.withColumns({"day": day[0], "at": day[1], "amount": F.col("amount").cast("decimal(12,2)")}).select(*[c.split()[0] for c in schema.split(", ")])
    tables.save_splits(rows, rows.where("id = 3"), rows.where("id = 9"), str(tmp_path), "csv")
    train, val, test = tables.load_splits(spark, str(tmp_path), "csv")
    assert train.schema.simpleString() == rows.schema.simpleString() == test.schema.simpleString()
    assert sorted(train.collect()) == sorted(rows.collect()) and val.collect() == rows.where("id = 3").collect() and test.count() == 0
    with pytest.raises(ValueError, match="missing values"):
        tables.save_splits(*[rows.withColumn("zip", F.lit(tables.MISSING))] * 3, str(tmp_path / "clash"), "csv")


def test_unknown_format_and_missing_path(spark, txn, tmp_path):
    with pytest.raises(ValueError):
        tables.save_splits(txn, txn, txn, str(tmp_path), "orc")
    with pytest.raises(FileNotFoundError):
        tables.load_splits(spark, str(tmp_path / "nowhere"))
    with pytest.raises(FileNotFoundError):
        tables.load_transactions(spark, str(tmp_path / "nowhere.csv"))


def test_csv_types_come_from_names(spark, txn, tmp_path):
    path = sinks.write_csv(txn.withColumn("V1", F.lit(1)), str(tmp_path / "t"))
    types = dict(tables.load_transactions(spark, path).dtypes)
    assert (types["TransactionID"], types["TransactionAmt"], types["V1"], types["ProductCD"]) == (
        "bigint", "double", "double", "string",
    )


def test_cache_is_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    path = str(tmp_path / "interim")
    assert tables.load_or_build(spark, path, build).count() == 5
    assert tables.load_or_build(spark, path, build).count() == 5
    assert built == [1]


def test_feature_splits_fall_back_to_raw(spark, txn, tmp_path):
    tables.save_splits(*time_aware_split(txn), str(tmp_path / "raw"))
    enrich = lambda *parts: tuple(p.withColumn("extra", F.lit(1)) for p in parts)
    train, _, _ = tables.load_feature_splits(spark, str(tmp_path / "features"), str(tmp_path / "raw"), enrich)
    assert "extra" in train.columns


def test_narrowing(spark):
    df = spark.createDataFrame(
        [(1, 300, 70000, 2**40, 1.5, None, True, "a"), (-128, 0, 0, 0, 2.5, None, False, None)],
        "a long, b long, c long, d long, e double, f double, g boolean, h string",
    )
    small, plan = narrowing.narrow_schema(df)
    assert [t for _, t in small.dtypes] == ["tinyint", "smallint", "int", "bigint", "float", "double", "tinyint", "string"]
    assert plan.count() == 8
    assert small.first()["c"] == 70000


def test_merge_and_rate(spark):
    txn = fixtures.txn(spark, SF)
    identity = fixtures.identity(spark, SF)
    both = joins.merge_tables(txn, identity)
    assert both.count() == txn.count()
    row = joins.enrichment_rate(txn, identity).first()
    assert row["join_rate"] == pytest.approx(identity.count() / txn.count())


def test_label_codes(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,), ("z",)], "c string").withColumn("isFraud", F.lit(0))
    fitted = coding.fit_label_encoders(train)
    codes = {r["value"]: r["code"] for r in fitted.stacked().collect()}
    assert codes == {"a": 0, "b": 1, "nan": 2, "z": 3}
    new = spark.createDataFrame([("z", 0), ("new", 0), (None, 1)], "c string, isFraud int")
    assert [r["c"] for r in coding.apply_codes(new, fitted).collect()] == [3, 0, 2]
    prepared, coded = coding.prepare_features(new, label_encoders=fitted)
    assert prepared.columns == ["isFraud", "c"] and coded == ["c"]
    with pytest.raises(KeyError):
        coding.prepare_features(new.drop("isFraud"))


def test_alignment(spark):
    df = spark.createDataFrame([(1, 2)], "b int, extra int")
    assert coding.align_columns(df, ["a", "b"]).first().asDict() == {"a": 0, "b": 1}


def test_scaler_is_population_and_keeps_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, k double")
    scaler = coding.Scaler.fit(df, ["x", "k"])
    assert scaler.means[0] == pytest.approx(4 / 3) and scaler.scales[1] == 1.0
    got = [r["x"] for r in scaler.transform(df).collect()]
    assert sum(got) == pytest.approx(0) and sum(v * v for v in got) / 3 == pytest.approx(1)


def test_median_imputation(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,), (9.0,)], "v double")
    assert [r["v"] for r in coding.impute_median(df, ["v"]).collect()] == [1.0, 4.0, 4.0, 9.0]


def test_exact_samples(txn):
    a = sampling.sample_exact(txn, 77)
    assert a.count() == a.select("TransactionID").distinct().count() == 77
    same(sampling.sample_exact(txn, 77, top_k_rows=0).select("TransactionID"), a, "TransactionID")
    assert sampling.sample_exact(txn, 10**6).count() == txn.count()
    assert sampling.sample_exact(txn, 10**6, top_k_rows=0).count() == txn.count()


def test_stratified_counts(txn):
    positives = txn.where("isFraud = 1").count()
    got = {r["isFraud"]: r["count"] for r in sampling.stratified_sample(txn, 300, 20).groupBy("isFraud").count().collect()}
    wanted = min(max(20, int(300 * positives / txn.count())), positives)
    assert got == {1: wanted, 0: 300 - wanted}
    assert sampling.stratified_sample(txn, 10**6).count() == txn.count()


def test_moving_average_needs_a_full_window(spark):
    bins = spark.range(30).select(F.col("id").cast("int").alias("bin"), F.col("id").cast("double").alias("fraud_rate"))
    got = rows(profile.centred_moving_average(bins).withColumn("k", F.format_string("%02d", "bin")), "k")
    filled = [r["bin"] for r in got if r["fraud_rate_ma"] is not None]
    assert filled == list(range(10, 21)) and got[10]["fraud_rate_ma"] == pytest.approx(9.5)


def test_time_buckets_are_right_closed(spark):
    df = spark.createDataFrame([(0, 1), (10, 0), (11, 1), (20, 0)], "TransactionDT long, isFraud int")
    got = rows(profile.time_buckets(df, bins=2), "bin")
    assert [(r["bin"], r["count"], r["dt_mid"]) for r in got] == [(0, 2, 5.0), (1, 2, 15.5)]


def test_ranking_shares(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.5)], "feature string, importance double")
    got = [(r["feature"], r["rank"], r["importance_pct"]) for r in profile.rank_by(df, "feature", "importance", 2).collect()]
    assert got == [("b", 1, 66.67), ("a", 2, 22.22)]


def test_families(spark):
    df = spark.createDataFrame([(1, None, None, 2, None)], "card1 int, V1 int, V150 int, D1 int, id_01 int")
    got = {r["family"]: (r["mean_null_pct"], r["n_columns"]) for r in profile.family_null_profile(df).collect()}
    assert got == {
        "Core": (0.0, 1), "D features": (0.0, 1), "V features (1-100)": (100.0, 1),
        "V features (101-200)": (100.0, 1), "Identity": (100.0, 1),
    }


def test_scratch_drops_its_tables(spark):
    with session.scratch(spark):
        kept = session.materialize(spark.range(3))
        assert kept.count() == 3
        path = session._tables[-1]
    assert path not in session._tables
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_more_than_forty_columns_with_gaps(spark):
    columns = {f"V{k}": F.when(F.col("id") % 2 == 0, 1.0) for k in range(60)}
    df = spark.range(20).withColumns(columns).withColumn("isFraud", (F.col("id") % 3 == 0).cast("int"))
    assert profile.missingness_vs_label(df).count() == 60


def test_malformed_and_decimal_csv_fields(spark, tmp_path):
    good, bad, broken = (str(tmp_path / n) for n in ("good", "bad", "broken"))
    head = "TransactionID,card2,addr1,ProductCD"
    for path, line in ((bad, "1,315.5,,x"), (broken, "1,abc,,x")):
        spark.createDataFrame([(head,), (line,)], "v string").coalesce(1).write.text(path)
    spark.createDataFrame([(head,), ("1,315.0,,x",), ("2,,404.0,y",)], "v string").coalesce(1).write.mode("overwrite").text(good)
    got = {tuple(r) for r in tables.read_csv(spark, good).collect()}
    assert got == {(1, 315, None, "x"), (2, None, 404, "y")}
    for path in (bad, broken):
        with pytest.raises(Exception):
            tables.read_csv(spark, path).collect()


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 4.0), (3, None), (4, 6.0)], "id long, x double")
    shares = {r["column"]: r["null_pct"] for r in profile.null_profile(df).collect()}
    assert shares == {"id": 0.0, "x": 50.0}
    assert [r["x"] for r in coding.impute_median(df, ["x"]).orderBy("id").collect()] == [5.0, 4.0, 5.0, 6.0]


def test_lookup_without_an_id_column_above_the_bound(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 3.0), ("b", 4.0)], "k string, v double")
    lookup = joins.Lookup.build(df.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.avg("v").alias("m")), ["k"], "n")
    small = joins.lookup_join(df, lookup, {"m": F.col("m")})
    large = joins.lookup_join(df, lookup, {"m": F.col("m")}, broadcast_rows=0)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_a_probe_key_with_most_rows_is_spread(spark):
    """Two keys and no weight: nine tenths of the probe rows hold one key that the fitted counts do not know as hot."""
    df = spark.range(60_000).selectExpr("id AS TransactionID", "if(id % 10 > 0, 7, id) AS a", "if(id % 10 > 0, 'x', if(id % 3 = 0, NULL, 'y')) AS b")
    table = df.select("a", "b").distinct().where("b IS NOT NULL").selectExpr("a", "b", "a * 2 AS v")
    lookup = joins.Lookup.build(table, ["a", "b"])
    code = F.xxhash64("a", "b").alias("__code")
    assert joins.hot_codes(df.select(code)) == [df.where("a = 7 AND b = 'x'").select(code).first()[0]]
    large = joins.lookup_join(df, lookup, {"v": F.col("v")}, broadcast_rows=0)
    same(large, joins.lookup_join(df, lookup, {"v": F.col("v")}), "TransactionID")
