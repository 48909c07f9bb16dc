from conftest import SF, same
from pyspark.sql import functions as F

from riskframe import fixtures
from riskframe.operators.velocity import compute_velocity_features, expected_feature_names
from riskframe.plans.features import FeaturePipeline, PipelineConfig
from riskframe.streaming import jobs, state


def stream_of(spark, txn, folder, parts):
    """Time-ordered files, one per micro-batch."""
    ordered = txn.orderBy("TransactionDT").collect()
    size = -(-len(ordered) // parts)
    for i in range(parts):
        piece = spark.createDataFrame(ordered[i * size : (i + 1) * size], txn.schema)
        piece.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(txn.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_row_features_equal_the_batch(spark, txn, tmp_path):
    fitted = FeaturePipeline(PipelineConfig(run_velocity=False)).fit(txn)
    stream = stream_of(spark, txn, str(tmp_path / "in"), 2)
    jobs.write_stream(jobs.row_features(stream, fitted), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    names = ["TransactionID", "hour_of_day", "amt_zscore_card1", "email_match", "card1_addr1_is_mode"]
    same(spark.read.parquet(str(tmp_path / "out")).select(*names), fitted.transform(txn).select(*names), "TransactionID")


def test_velocity_over_micro_batches_equals_one_batch(spark, txn, tmp_path):
    stream = stream_of(spark, txn, str(tmp_path / "in"), 4)
    entities = ["card1", "addr1"]
    jobs.velocity_stream(
        stream, str(tmp_path / "out"), str(tmp_path / "history"), str(tmp_path / "state"), entity_cols=entities
    ).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("batch").distinct().count() == 4
    names = ["TransactionID", *expected_feature_names(entities)]
    same(out.select(*names), compute_velocity_features(txn, entities).select(*names), "TransactionID")


def test_a_replayed_batch_overwrites_itself(spark, txn, tmp_path):
    run = jobs.velocity_batch(str(tmp_path / "out"), str(tmp_path / "history"), entity_cols=["card1"])
    early, late = txn.where("TransactionDT < 1000000"), txn.where("TransactionDT >= 1000000")
    run(early, 0)
    run(late, 1)
    run(late, 1)
    out = spark.read.parquet(str(tmp_path / "out"))
    names = ["TransactionID", *expected_feature_names(["card1"])]
    same(out.select(*names), compute_velocity_features(txn, ["card1"]).select(*names), "TransactionID")


def test_monitor_equals_the_batch(spark, tmp_path):
    events = fixtures.table(spark, SF, "events")
    rows = lambda df: df.select(
        F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "error").cast("int").alias("isFraud")
    )
    stream = jobs.label_rate_monitor(rows(jobs.read_table_stream(spark, SF, "events")), "at")
    jobs.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    closed = spark.read.parquet(str(tmp_path / "out"))
    batch = jobs.label_rate_monitor(rows(events), "at")
    assert closed.count() > 0
    same(closed, batch.join(closed.select("window_start"), "window_start"), "window_start")


HOUR = {"1h": 3_600, "6h": 21_600}


def test_keyed_state_equals_one_batch(spark, txn, tmp_path):
    """Ordered replay in five batches, NULL entities and amounts included; the state of passed chunks is gone."""
    odd = txn.withColumn("TransactionAmt", F.when(F.col("TransactionID") % 11 != 0, F.col("TransactionAmt")))
    odd = odd.withColumn("TransactionDT", F.col("TransactionDT") - F.col("TransactionDT") % 7).where("TransactionDT < 2000000")
    stream = stream_of(spark, odd, str(tmp_path / "in"), 5)
    entities = ["card1", "addr1"]
    query = jobs.write_stream(state.velocity_state(stream, entities, HOUR, lateness=60), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    got = state.wide_velocity(spark.read.parquet(str(tmp_path / "out")), entities, HOUR)
    names = ["TransactionID", *expected_feature_names(entities, HOUR)]
    want = compute_velocity_features(odd, entities, HOUR)
    assert want.where("vel_card1_6h_count > 1").count() > 0
    same(got.select(*names), want.select(*names), "TransactionID")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    keys = odd.select("card1").distinct().count() + odd.select("addr1").distinct().count()
    made = sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"])
    # chunks that the watermark has not passed: at most two and the one to come, for every entity
    assert held[-1] <= 3 * keys < made


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    schema = "TransactionID long, TransactionDT long, TransactionAmt double, card1 string"
    batches = [
        [(1, 0, 1.0, "a"), (2, 100, 2.0, "a"), (9, None, 5.0, "a")],
        [(3, 50_000, 4.0, "a"), (4, 50_100, None, "a"), (5, 50_100, float("nan"), None)],
        [(7, 50_200, 16.0, "a")],
        [(6, 49_400, 8.0, "a"), (8, 50_050, 32.0, "a"), (10, 50_300, 1.0, "a"), (11, 50_300, 1.0, None)],  # 6 is behind 50,100 - 600, 8 is not
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = state.velocity_state(stream, ["card1"], {"1h": 3_600}, lateness=600)
    jobs.write_stream(made, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = state.wide_velocity(spark.read.parquet(str(tmp_path / "out")), ["card1"], {"1h": 3_600}).collect()
    got = {r["TransactionID"]: (r["vel_card1_1h_count"], r["vel_card1_1h_sum"], r["vel_card1_1h_mean_amt"]) for r in out}
    assert got == {
        1: (0, 0.0, 0.0), 2: (1, 1.0, 1.0), 9: (0, 0.0, 0.0), 3: (0, 0.0, 0.0), 4: (1, 4.0, 4.0), 5: (0, 0.0, 0.0),
        7: (1, 4.0, 4.0), 8: (1, 4.0, 4.0), 10: (3, 52.0, 52.0 / 3), 11: (0, 0.0, 0.0),
    }


def test_calls_and_states_do_not_grow_with_the_entities(spark, tmp_path):
    """Many entities share few keys, none of whose rows see those of another; NULL is an entity of its own."""
    schema = "TransactionID long, TransactionDT long, TransactionAmt double, card1 string"
    rows = [(i, 1_000 * (i // 900) + i % 50, float(i % 7), None if i % 300 == 0 else f"c{i % 300}") for i in range(3_600)]
    df = spark.createDataFrame(rows, schema)
    stream = stream_of(spark, df, str(tmp_path / "in"), 3)
    query = jobs.write_stream(
        state.velocity_state(stream, ["card1"], HOUR, buckets=4), str(tmp_path / "out"), str(tmp_path / "state")
    )
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 4 * 2
    got = state.wide_velocity(spark.read.parquet(str(tmp_path / "out")), ["card1"], HOUR)
    names = ["TransactionID", *expected_feature_names(["card1"], HOUR)]
    same(got.select(*names), compute_velocity_features(df, ["card1"], HOUR).select(*names), "TransactionID")


def test_bucketed_state_by_default(spark, tmp_path):
    """The default bounds the states of a chunk by the number of buckets, whatever the number of entities."""
    schema = "TransactionID long, TransactionDT long, TransactionAmt double, card1 string"
    df = spark.createDataFrame([(i, i // 100, 1.0, f"c{i % 1_500}") for i in range(3_000)], schema)
    stream = stream_of(spark, df, str(tmp_path / "in"), 1)
    query = jobs.write_stream(state.velocity_state(stream, ["card1"], HOUR), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 2 * state.BUCKETS < 1_500
