"""Session construction and shared scratch locations.

On a cluster the scratch location is the shared folder named by
``spark.checkpoint.dir``; only a local master gets an invented one (under the
system temp dir) when the session has none.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Per-row work after small shuffles (tokenising hits, span search) is CPU-bound:
    # do not let AQE merge such shuffles into a single task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "quarry",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "8g"
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    Only a purely local master, where driver and executors are one process, may
    be given a temporary one; a cluster must name its own."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="quarry-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder, with that folder's
    scheme; the path ends in `name`, so extension-driven formats (.jsonl, .gz) are
    honoured."""
    return "/".join([ensure_checkpoint_dir(spark).rstrip("/"), f"run-{uuid.uuid4().hex[:12]}", name])


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (for files: their bytes); no job runs for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def ensure_parallelism(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread CPU-heavy per-row work (encoding, tokenisation) over the cluster.

    Only an input that is known to be too small for a split per core is
    redistributed (round robin); a larger one, or one of unknown size, is left as it
    is, so no shuffle is added at scale."""
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if plan_bytes(df) < target * split:
        return df.repartition(target)
    return df


def stored(df: DataFrame, name: str, *, compression: str | None = None) -> DataFrame:
    """`df` written to a Parquet table below the shared checkpoint folder and read back.

    Runs a job. The lineage ends at files that every executor can read, and later plans
    know the table's size in bytes: Spark broadcasts it only if that is below its threshold."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
