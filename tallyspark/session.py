"""Session defaults and the shared scratch/checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, partitions: int = 8, app: str = "tallyspark",
              extra: dict | None = None) -> SparkSession:
    """Session for tests, bench and local runs (a cluster passes its own)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be configured (shared storage); only a local
    session without the setting gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="tallyspark-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    base = base.rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


#: Bytes below which a table is spread over all cores: reading so little again
#: costs less than leaving cores idle.
SPREAD_BYTES = 256 << 20


def spread(df, partitions: int | None = None, most: int = SPREAD_BYTES):
    """Repartition a table of at most ``most`` bytes (by Spark's own estimate of
    its files), so that the row-wise work that follows uses every core even if it
    is one row group.  Larger tables pass through: their scan has splits
    enough, and no shuffle is added."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > most:
        return df
    return df.repartition(partitions or df.sparkSession.sparkContext.defaultParallelism)


def dealt(df, key: str, task_bytes: int):
    """The rows dealt by ``key`` to tasks of about ``task_bytes`` bytes of the table's
    files, one a core at least: what a task holds of it, and of aggregates by that
    key, does not grow with the table."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // task_bytes)), key)


def cluster_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 << 20) -> dict:
    """Settings for a cluster run, sized from the input volume.

    Shuffle partitions start at ~one per ``partition_bytes`` of input (and
    at least 2× the cores), AQE coalesces small ones and splits skewed ones;
    scans read ``partition_bytes`` splits; broadcasts stay at Spark's
    default size check (only bounded tables are broadcast explicitly).
    """
    parts = max(2 * total_cores, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    }
