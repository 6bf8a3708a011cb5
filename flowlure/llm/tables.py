"""Reading the pipeline's tables and cutting lineage in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from flowlure.session import ensure_checkpoint_dir

CLEAN_SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the cluster's checkpoint folder and return a reader over it.

    The written table cuts the lineage: a lost executor costs only the tasks that were
    running. Shuffle files of the writing job are dropped when the write ends, so a chain
    of kept tables never holds the shuffles of all its steps on disk at once.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLE, None)
    spark.conf.set(CLEAN_SHUFFLE, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLE)
        else:
            spark.conf.set(CLEAN_SHUFFLE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def drop_kept(*frames: DataFrame) -> None:
    """Delete tables made by ``keep`` that no later step reads."""
    for df in frames:
        path = getattr(df, "_llm_path", None)
        if path:
            spark = df.sparkSession
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
