"""Materialising shared intermediates in the cluster's checkpoint folder.

When one intermediate feeds several branches of a job (attacker flows feed detection,
totals and saved-flow counts), Spark would otherwise re-run its whole lineage from the
scan once per branch. Writing it once as parquet under ``spark.checkpoint.dir`` and
reading it back cuts the lineage (a lost executor re-reads the written table instead
of re-scanning the archive) and the re-read is columnar with pruning and pushdown.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from flowlure.session import ensure_checkpoint_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and return a reader over it.

    The folder comes from the session (``spark.checkpoint.dir``); only when none is
    configured (local tests) a fresh temporary folder is set.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/flowlure-tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class ScratchTables:
    """Materialise intermediates for one job and delete exactly those tables afterwards.

    ``with ScratchTables(spark) as keep: att = keep(df, "attacker-flows"); ...`` — on exit
    the folders written through ``keep`` are removed with the cluster's file system API,
    so a 100 TB job does not leave its intermediates behind. Use only around code that
    has finished all actions on the kept tables (e.g. after the job's writes).
    """

    def __init__(self, spark):
        self.spark = spark
        self.paths: list[str] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        root = ensure_checkpoint_dir(self.spark)
        path = f"{root.rstrip('/')}/flowlure-tables/{name}-{uuid.uuid4().hex}"
        df.write.mode("overwrite").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self):
        return self

    def __exit__(self, *exc) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        self.paths.clear()
