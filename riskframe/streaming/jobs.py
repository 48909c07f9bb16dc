"""Structured Streaming versions of the features: row-wise, velocity, and a label-rate monitor.

Row-wise features and encoder lookups need no state: `FeaturePipeline` with velocity switched off takes a
stream as it is. Velocity comes in two forms. `velocity_state` keeps the last window of every entity as keyed operator
state with a watermark (module `state`). `velocity_stream` keeps its history as a Parquet table next to the output:
each micro-batch is computed by the batch operator over the last window of history, so hot entities are
cut into chunks here too. The history is partitioned by day; days that no row within the allowed lateness can see any
more are deleted, so its size is bounded by the longest window and the lateness.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskframe.functions.columns import DAY
from riskframe.operators.velocity import ENTITY_COLS, VELOCITY_WINDOWS, compute_velocity_features
from riskframe.plans.features import FeaturePipeline, PipelineConfig
from riskframe.schema import AMOUNT, LABEL, TIME


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table of a folder as a stream; the schema comes from the files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def row_features(stream: DataFrame, fitted: FeaturePipeline) -> DataFrame:
    """Row-wise features and encoder lookups on a stream, from encoders fitted on a batch."""
    plan = FeaturePipeline(PipelineConfig(run_velocity=False))
    plan.amount_encoders, plan.address_encoders = fitted.amount_encoders, fitted.address_encoders
    plan.is_fitted_ = fitted.is_fitted_
    return plan.transform(stream)


def write_stream(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Drains everything available into Parquet and stops."""
    return (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _folder(spark: SparkSession, path: str):
    """The file system of a path and the path, so that any store Spark writes to can be listed."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def history_days(spark: SparkSession, history: str, batch_id: int) -> list[int]:
    """Days that earlier batches left in a history table; bounded by the longest window and the lateness."""
    fs, path = _folder(spark, history)
    if not fs.exists(path):
        return []
    names = lambda p: [s.getPath().getName() for s in fs.listStatus(p)]
    days = [n for n in names(path) if n.startswith("day=")]
    earlier = lambda day: any(
        int(b.removeprefix("batch=")) < batch_id for b in names(_folder(spark, f"{history}/{day}")[1]) if b.startswith("batch=")
    )
    return sorted(int(d.removeprefix("day=")) for d in days if earlier(d))


def drop_days(spark: SparkSession, history: str, days: Sequence[int]) -> None:
    for day in days:
        fs, path = _folder(spark, f"{history}/day={day}")
        fs.delete(path, True)


def velocity_batch(
    out: str,
    history: str,
    entity_cols: Sequence[str] = ENTITY_COLS,
    windows: Mapping[str, int] = VELOCITY_WINDOWS,
    lateness: int = DAY,
    **options,
) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` function. Both tables are partitioned by batch, so a replayed batch overwrites itself.

    A row sees all earlier rows that arrived in its own or an earlier batch; rows already written are not
    amended by later arrivals. A row later than `lateness` seconds behind the newest time seen is written too, but
    sees only the history that is left.
    """
    longest = max(windows.values())
    needed = list(dict.fromkeys([TIME, AMOUNT, *entity_cols]))

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        first = rows.agg(F.min(TIME).alias("t")).first()["t"]
        if first is not None:
            days = history_days(spark, history, batch_id)
            since = first - longest
            wanted = [d for d in days if d >= since // DAY]
            past = None
            if wanted:
                past = spark.read.option("basePath", history).parquet(*[f"{history}/day={d}" for d in wanted])
                past = past.where((F.col("batch") < batch_id) & (F.col(TIME) >= since)).select(*needed)
            features = compute_velocity_features(rows, entity_cols, windows, history=past, **options)
            features.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            # only earlier batches move the limit, so that a replay of this one finds what it found before
            oldest = (max(days) * DAY - lateness - longest) // DAY if days else first // DAY
            seen = rows.select(*needed).where(F.col(TIME).isNotNull())
            seen = seen.withColumns({"day": F.floor(F.col(TIME) / DAY).cast("long"), "batch": F.lit(batch_id)}).where(F.col("day") >= oldest)
            seen.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(history)
            drop_days(spark, history, [d for d in days if d < oldest])
        rows.unpersist()

    return run


def velocity_stream(
    stream: DataFrame, out: str, history: str, checkpoint: str, **options
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(velocity_batch(out, history, **options))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def label_rate_monitor(
    stream: DataFrame, ts: str, label: str = LABEL, width: str = "1 hour", lateness: str = "10 minutes"
) -> DataFrame:
    """Rows and label rate per tumbling window; works on a stream and on a batch."""
    rows = stream.withWatermark(ts, lateness) if stream.isStreaming else stream
    rates = rows.groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(label).alias("label_rate")
    )
    return rates.select(F.col("w.start").alias("window_start"), "n", "label_rate")
