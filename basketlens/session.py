"""Spark session settings shared by tests, the bench and the query catalog."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  AQE re-plans joins from runtime sizes
# (broadcast only when the measured side is small, sort-merge beyond it),
# coalesces small shuffle partitions and splits skewed join partitions.
BASE_CONF: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    # Generated code is cached by its text; the default 100 entries are too
    # few for a suite of multi-stage queries run one after the other, so
    # plans kept being recompiled.  Static: takes effect at session start.
    "spark.sql.codegen.cache.maxEntries": "2000",
}


# Settings for a large cluster (100 TB inputs, ~1000 executors).  Shuffle
# partitions start high and AQE coalesces them to ~256 MB; file splits are
# 256 MB; skewed join partitions are split; tasks and stages retry so a lost
# executor only re-runs its tasks, and decommissioning executors hand their
# shuffle blocks over instead of losing them.
CLUSTER_CONF: dict[str, str] = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.task.maxFailures": "8",
    "spark.stage.maxConsecutiveAttempts": "8",
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
}


def build_session(
    master: str = "local[8]",
    shuffle_partitions: int = 8,
    app_name: str = "basketlens",
    extra_conf: dict[str, str] | None = None,
    local_memory: str = "8g",
) -> SparkSession:
    """Create (or reuse) a session with the library's settings.

    On a cluster, pass ``master=None`` so that ``spark-submit`` decides, and
    ``extra_conf=CLUSTER_CONF`` (it overrides ``shuffle_partitions``); AQE
    then coalesces partitions that turn out small.  With a ``local`` master
    all tasks run inside the driver JVM, whose heap (``local_memory``) is
    then the only memory setting that matters; it applies when this call
    starts the JVM.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = local_memory
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.master.startswith("local"):
        checkpoint_dir(spark)  # tests and local runs: a scratch folder if unset
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder (HDFS, object store) in that setting and
    it is used as is.  Only when it is unset (local tests) is a folder set
    here: ``fallback`` or a fresh one under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if fallback is None and not sc.master.startswith("local"):
        # a folder on the driver's disk is not visible to executors
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, object store) on a cluster")
    path = fallback or tempfile.mkdtemp(prefix="basketlens-ckpt-")
    os.makedirs(path, exist_ok=True)
    sc.setCheckpointDir(path)
    return path
