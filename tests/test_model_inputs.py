from riskframe import session
from riskframe.plans import catalog


def test_model_inputs_are_written_once(spark, tmp_path):
    """The folder that the queries share is the only table of all inputs."""
    rows = [(i, f"2024-01-{1 + i // 20:02d} 00:{i % 20:02d}:00", i % 9, "error" if i % 3 else "view", float(i % 50), '{"k": 1}') for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.selectExpr("event_id", "CAST(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    before = len(session._tables)
    made = catalog.trained_rows(spark, str(tmp_path))
    assert made.count() == 200 and {*catalog.TREE_INPUTS, *catalog.BAYES_INPUTS} <= {*made.columns}
    for path in session._tables[before:]:
        assert not {*catalog.TREE_INPUTS} <= {*spark.read.parquet(path).columns}
