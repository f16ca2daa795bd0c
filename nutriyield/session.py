"""Spark session defaults for the library.

On a cluster the session is created by the platform; we only read settings
from it.  ``get_spark`` is for tests, the bench and local runs.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # runtime (measured) size check before any join is turned into a broadcast
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128MB",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "nutriyield", driver_memory: str = "8g") -> SparkSession:
    """Build (or reuse) a session with AQE and skew handling on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (spark.checkpoint.dir).

    Only when the session has none (local tests) do we set one of our own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d
    if not spark.sparkContext.master.startswith("local"):
        # a machine-local folder would not survive the loss of an executor
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running "
                           "iterative operators on a cluster")
    d = os.environ.get("NUTRIYIELD_LOCAL_CHECKPOINT") or tempfile.mkdtemp(prefix="nutriyield-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    spark.conf.set("spark.checkpoint.dir", d)
    return d


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df):
    """``df``, checkpointed over every core: a small table whose rows each stand for much work
    (restarts, permutations) comes in as few partitions as its bytes fill."""
    sc = df.sparkSession.sparkContext
    return cut_lineage(df.repartition(2 * max(sc.defaultParallelism, 1)))
