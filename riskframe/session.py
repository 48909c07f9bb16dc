"""Spark session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

logger = logging.getLogger(__name__)


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "riskframe") -> SparkSession:
    """Session for tests and the bench. A cluster passes its own session instead."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # the JIT never compiles methods above 8000 bytes of bytecode; fall back to smaller ones before that
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, or a fresh one where it is unset (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="riskframe-")
    elif configured.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        logger.warning("spark.checkpoint.dir is %s: every machine must see the same folder there", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_dir(spark).rstrip('/')}/riskframe-{name}-{uuid.uuid4().hex}"


_tables: list[str] = []  # folders that materialize() has written and nobody has dropped


def own_folder(path: str) -> str:
    """Leave a folder to the `scratch` around the caller, as those of materialize() are."""
    _tables.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owner of the tables that materialize() writes inside: they are deleted at the end.

    Use it around work whose result has been written elsewhere, since a lazy DataFrame may still read them.
    """
    before = len(_tables)
    try:
        yield
    finally:
        for path in _tables[before:]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        del _tables[before:]


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it from there.

    Lineage ends at the table, so a lost executor costs a re-read and never a recomputation. Being Parquet,
    later passes read only the columns they use. The table stays until the `scratch` around it ends.
    """
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    _tables.append(path)
    return df.sparkSession.read.parquet(path)
