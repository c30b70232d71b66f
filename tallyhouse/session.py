"""Session settings, size checks and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Inputs of at least so many splits stay where they are.
SMALL_SPLITS = 16
# Temporary folders of local sessions that name no shared one, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(app: str = "tallyhouse", cpus: str | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster use its own session."""
    n = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def work_folder(spark: SparkSession) -> str:
    """Shared folder for written intermediates: ``spark.checkpoint.dir``.

    A temporary folder is used only where the setting is absent and the master is
    local; on a cluster a machine-local folder would be invisible to executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="tallyhouse-")
    return _LOCAL_FOLDERS[context.applicationId]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives executor loss."""
    path = f"{work_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fan_out(df: DataFrame) -> DataFrame:
    """Spread a small input over the cores before heavy per-row work.

    A file of one row group is one split and would keep one core busy. Only inputs of fewer
    than ``SMALL_SPLITS`` splits are dealt out, so however many cores there are, a large
    table is never shuffled for this.
    """
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, SMALL_SPLITS)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
