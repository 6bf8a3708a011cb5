"""Flow archive reader: parquet partitioned by day as ``_yyyymd=Y-M-D`` (no zero padding)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOW_COLUMNS = ("Proto", "SrcAddr", "DstAddr", "Dport", "State", "StartTime")
PARTITION_COLUMN = "_yyyymd"
FIRST_DAY = "1970-01-01"

RAW_FLOW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in FLOW_COLUMNS]
    + [T.StructField(PARTITION_COLUMN, T.StringType(), True)]
)


def partition_day(col=PARTITION_COLUMN):
    """Partition value ``2017-3-8`` -> DATE."""
    return F.col(col).try_cast("date")


def read_flows_of_days(spark: SparkSession, root: str, days: DataFrame) -> DataFrame:
    """Flows of the days in ``days`` (column ``day`` DATE), which are only known when the job runs.

    A left-semi join on the partition column: where ``days`` is broadcast, Spark prunes the
    archive's folders by its rows before it reads a file (a dynamic pruning filter), so a
    strategy table decides which days of the archive are read.
    """
    # Spark prunes only by a side with a comparison in it; this one holds for every date of an archive.
    wanted = days.where(F.col("day") >= F.lit(FIRST_DAY).cast("date")).select(F.date_format("day", "yyyy-M-d").alias(PARTITION_COLUMN)).distinct()
    return _archive(spark, root).join(wanted, PARTITION_COLUMN, "left_semi").select(*FLOW_COLUMNS)


def read_folders(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """Flows of the folders with the given partition values, with the partition column."""
    return _archive(spark, root).where(F.col(PARTITION_COLUMN).isin(names))


def _archive(spark: SparkSession, root: str) -> DataFrame:
    return (spark.read.option("basePath", root)
            .option("mergeSchema", "false")
            .schema(RAW_FLOW_SCHEMA)
            .parquet(root))


def read_flow_archive(spark: SparkSession, root: str, days: Iterable[str] | None = None,
                      start: str | None = None, end: str | None = None) -> DataFrame:
    """Read the archive root once; select days by partition filter, never by path loops.

    ``days`` are partition values such as ``"2017-3-8"`` or glob patterns such as
    ``"2017-3-*"`` / ``"2016-*"``; ``start``/``end`` are ISO dates (inclusive). All become
    ``PartitionFilters`` so only matching day folders are listed and read; the six used
    columns are the only ones in ``ReadSchema``.
    """
    df = _archive(spark, root)
    if days is not None:
        days = [days] if isinstance(days, str) else list(days)
        exact = [d for d in days if not any(ch in d for ch in "*?")]
        globs = [d for d in days if any(ch in d for ch in "*?")]
        conds = [F.col(PARTITION_COLUMN).isin(exact)] if exact else []
        conds += [F.col(PARTITION_COLUMN).like(g.replace("*", "%").replace("?", "_")) for g in globs]
        # No day chosen: no rows.
        df = df.where(reduce(lambda a, b: a | b, conds, F.lit(False)))
    if start is not None:
        df = df.where(partition_day() >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(partition_day() <= F.lit(end).cast("date"))
    return df.select(*FLOW_COLUMNS)
