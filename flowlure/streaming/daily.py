"""Daily port statistics kept current while day folders land in the archive.

Every statistic of a day follows from that day's distinct (source, host, port, unused)
tuples, in whatever folders their flows lie. So the stream keeps those tuples per folder:

* the stream (file source over the archive root) only tells which ``_yyyymd`` values a
  micro-batch touched;
* the batch job re-reads exactly those folders from the archive: the distinct partition
  values of the batch (one per day folder, a few per batch; capped by
  ``max_files_per_trigger``) become a static partition filter, so only those folders are
  listed and scanned; their tuples replace the folders' earlier ones, written by folder and
  day of StartTime;
* every day with a tuple in a touched folder is recomputed from the tuples of all folders,
  which are merged by day, however far from its day a flow was stored;
* both tables are written with dynamic partition overwrite, so other folders and days stay
  as they are and a re-run of a batch after a failure gives the same files.

Flows without a readable StartTime have no day and no statistic, as in the batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlure import config
from flowlure.operators import daily_port_statistics, prepare_flows
from flowlure.plans.persist import ScratchTables
from flowlure.sources.flows import PARTITION_COLUMN, RAW_FLOW_SCHEMA, read_folders

TUPLES = f"SrcAddr STRING, DstAddr STRING, Dport INT, unused BOOLEAN, {PARTITION_COLUMN} STRING, day DATE"


def _replace(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def update_daily_statistics(spark: SparkSession, archive: str, touched: DataFrame, output: str,
                            prefix=config.NETWORK_PREFIX_WIDE, tuples: str | None = None) -> None:
    """Renew the tuples of the touched folders (``tuples``, by default beside ``output``) and
    recompute the days that they hold."""
    # Partition values only (metadata): one per day folder present in this micro-batch.
    names = [r[0] for r in touched.select(PARTITION_COLUMN).distinct().collect() if r[0] is not None]
    if not names:
        return
    tuples = tuples or f"{output.rstrip('/')}-tuples"
    flows = prepare_flows(read_folders(spark, archive, names), prefix, carried=(PARTITION_COLUMN,)).where(F.col("day").isNotNull())
    _replace(flows.select("SrcAddr", "DstAddr", "Dport", "unused", PARTITION_COLUMN, "day").distinct(), tuples, PARTITION_COLUMN, "day")
    held = spark.read.schema(TUPLES).option("basePath", tuples).parquet(tuples)
    days = [r[0] for r in held.where(F.col(PARTITION_COLUMN).isin(names)).select("day").distinct().collect()]
    if days:
        with ScratchTables(spark) as keep:
            _replace(daily_port_statistics(held.where(F.col("day").isin(days)), share=keep), output, "day")


def start_daily_statistics_stream(spark: SparkSession, archive: str, output: str, checkpoint: str,
                                  prefix=config.NETWORK_PREFIX_WIDE, available_now: bool = True,
                                  processing_time: str | None = None, max_files_per_trigger: int = 1000):
    """Start the stream; ``available_now`` processes what is there and stops."""
    arrivals = (spark.readStream.schema(RAW_FLOW_SCHEMA).option("basePath", archive)
                .option("maxFilesPerTrigger", max_files_per_trigger).parquet(archive)
                .select(PARTITION_COLUMN))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        update_daily_statistics(spark, archive, batch, output, prefix)

    writer = arrivals.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    if processing_time:
        writer = writer.trigger(processingTime=processing_time)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
