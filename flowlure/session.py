"""Session helpers for tests, the bench and local runs.

Library operators never touch session state; only these helpers do.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "flowlure", extra: dict | None = None) -> SparkSession:
    """A local session with the settings the operators are designed for.

    AQE stays on: it turns small derived tables (per-day totals, strategies) into
    broadcasts from their measured size and splits skewed join partitions at run time.
    """
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        # Call-site capture costs several driver<->JVM round trips per column function.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def default_parallelism(spark: SparkSession) -> int:
    """Total task slots of the cluster (shuffle partitions where the context is not reachable)."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster configured, if any."""
    try:
        configured = spark.sparkContext.getCheckpointDir()
        if configured:
            return configured
        return spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    except Exception:  # no SparkContext on this client (Spark Connect)
        return spark.conf.get(CHECKPOINT_CONF, None)


def _local_folder(spark: SparkSession) -> str:
    """A fresh temporary folder, on a local master only: on a cluster each machine would use its own disk."""
    master = spark.conf.get("spark.master", None) or ""
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="flowlure-ckpt-")


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the configured checkpoint folder; set one only where none is configured.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is; where it
    is unset there, this is an error. Only a local master falls back to a temporary folder.
    """
    current = checkpoint_dir(spark)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the folder is only used as a path for written tables
        return current or fallback or _local_folder(spark)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    target = fallback or _local_folder(spark)
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target
