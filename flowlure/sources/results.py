"""Result sinks. A path that exists is an error unless the caller says how to treat it."""

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by=None) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header line (one part file per task; merge with a file tool if needed)."""
    df.write.mode(mode).option("header", True).csv(path)
