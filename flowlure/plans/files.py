"""Registered queries that go through files: each writes to the shared folder and reads back.

The written tables lie in the folder that the cluster names in ``spark.checkpoint.dir``; the
rows returned are those that came back, so a format that loses anything differs from its SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlure.operators import (
    attack_probability_daily,
    attacker_flows,
    daily_statistics_document,
    open_port_probability_daily,
    prepare_flows,
    strategy_long,
)
from flowlure.plans import catalog
from flowlure.plans.persist import materialize
from flowlure.session import ensure_checkpoint_dir
from flowlure.sources import (
    read_daily_statistics,
    read_flow_archive,
    read_flows_of_days,
    read_statistics_document,
    read_statistics_lines,
    read_strategies,
    strategy_records_fixture,
    write_csv,
    write_daily_statistics,
    write_parquet,
    write_statistics_lines,
    write_strategies,
)
from flowlure.sources.flows import PARTITION_COLUMN

#: Strategies of every n-th day of the month are evaluated: only those days of the archive are read.
EVALUATED_EVERY = 5
#: Days that the archive reader is asked for, as a glob of partition values: the 10th to the 19th.
ARCHIVE_DAYS = "2024-1-1?"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/flowlure-files/{name}-{uuid.uuid4().hex}"


def archive(spark: SparkSession, sf: str) -> str:
    """The derived flows as an archive: one folder per day of StartTime."""
    path = _folder(spark, "archive")
    raw = catalog.raw_flows(spark, sf)
    day = F.date_format(F.replace(F.substring("StartTime", 1, 10), F.lit("/"), F.lit("-")).cast("date"), "yyyy-M-d")
    # Rows of a day meet in few tasks, so its folder gets few files; a large day is split.
    dealt = raw.withColumn(PARTITION_COLUMN, day).hint("rebalance", PARTITION_COLUMN)
    dealt.write.partitionBy(PARTITION_COLUMN).parquet(path)
    return path


def q_archive_days(spark, sf):
    """Prepared flows of the days that a glob of partition values names."""
    return prepare_flows(read_flow_archive(spark, archive(spark, sf), days=[ARCHIVE_DAYS]))


def evaluated_days(strategies: DataFrame) -> DataFrame:
    return strategies.where(F.day("application_date") % EVALUATED_EVERY == 0).select(F.col("application_date").alias("day")).distinct()


def q_archive_strategy_days(spark, sf):
    """Attacker flows on the days on which the chosen strategies of a strategy file apply, pruned by them."""
    path = _folder(spark, "strategies")
    write_strategies(strategy_records_fixture(catalog.eval_base(spark, sf)), path)
    days = evaluated_days(strategy_long(read_strategies(spark, path)))
    flows = materialize(prepare_flows(read_flows_of_days(spark, archive(spark, sf), days), drop_null_port=True), "strategy-days")
    return attacker_flows(flows, share=materialize)


def q_deduplicated_flows(spark, sf):
    """Prepared flows of a table in which a third of the raw rows stand twice and a ninth three times."""
    events = catalog.events(spark, sf)
    repeated = events.unionByName(events.where("event_id % 3 = 0")).unionByName(events.where("event_id % 9 = 0"))
    return prepare_flows(catalog.flows_from_events(repeated), dedupe=True, share=materialize)


def q_strategies_file(spark, sf):
    """Strategies written as one JSON object a line and read back, one row per port."""
    path = _folder(spark, "strategies")
    write_strategies(strategy_records_fixture(catalog.eval_base(spark, sf)), path)
    return strategy_long(read_strategies(spark, path))


def q_strategies_documents(spark, sf):
    """Strategies as ``{"data": [...]}`` documents with port maps, a document a day, read back."""
    path = _folder(spark, "strategy-documents")
    records = strategy_records_fixture(catalog.eval_base(spark, sf))
    maps = records.withColumn("stg", F.map_from_entries(F.transform("stg", lambda e: F.struct(e["port"].cast("string"), e["prob"]))))
    documents = maps.groupBy("date").agg(F.collect_list(F.struct(*maps.columns)).alias("data"))
    documents.select(F.to_json(F.struct("data"), {"pretty": "true"}).alias("value"), F.col("date").alias("written")).write.partitionBy("written").text(path)
    return strategy_long(read_strategies(spark, path, document=True))


def q_statistics_records(spark, sf):
    """Daily statistics as one JSON record a line, read back."""
    path = _folder(spark, "statistics")
    write_daily_statistics(catalog.stats(spark, sf), path)
    return read_daily_statistics(spark, path)


def q_statistics_lines(spark, sf):
    """Daily statistics as nested lines, read back; ``stamped``: the line says when it was written."""
    path = _folder(spark, "lines")
    write_statistics_lines(daily_statistics_document(catalog.stats(spark, sf)), path)
    made = spark.read.schema("day DATE, created STRING").json(path).select(
        "day", (F.col("created").try_cast("timestamp_ntz") > F.lit("2020-01-01").cast("timestamp_ntz")).alias("stamped"))
    return read_statistics_lines(spark, path).join(made, "day")


def q_statistics_documents(spark, sf):
    """Daily statistics as the nested document, one of each day, in which ports without an
    attacker and ports without an open host are left out of the respective map; read back."""
    path = _folder(spark, "documents")
    maps = daily_statistics_document(catalog.stats(spark, sf))
    seen = lambda c: F.map_filter(c, lambda k, v: v > 0)
    entry = F.struct(seen("attacker_strategy").alias("attacker_strategy"), seen("production_distribution").alias("production_distribution"))
    day = F.concat(F.col("day").cast("string"), F.lit(" 00:00:00.0"))
    document = F.struct(F.create_map(day, entry).alias("data"), F.create_map(F.lit("created by"), F.lit("daily statistics")).alias("metadata"))
    maps.select(F.to_json(document, {"pretty": "true"}).alias("value"), F.col("day").cast("string").alias("written")).write.partitionBy("written").text(path)
    return read_statistics_document(spark, path)


def q_parquet_results(spark, sf):
    """Attack probabilities as Parquet, a folder a day, read back with their types."""
    path = _folder(spark, "parquet")
    found = attack_probability_daily(catalog.wide_flows(spark, sf), share=materialize)
    write_parquet(found, path, partition_by="day")
    return spark.read.schema(found.schema).parquet(path)


def q_csv_results(spark, sf):
    """Open-port shares as CSV with a header, read back by name."""
    path = _folder(spark, "csv")
    found = open_port_probability_daily(catalog.wide_flows(spark, sf), share=materialize)
    write_csv(found, path)
    return spark.read.option("header", True).option("enforceSchema", False).schema(found.schema).csv(path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "archive_days": q_archive_days,
    "archive_strategy_days": q_archive_strategy_days,
    "deduplicated_flows": q_deduplicated_flows,
    "strategies_file": q_strategies_file,
    "strategies_documents": q_strategies_documents,
    "statistics_records": q_statistics_records,
    "statistics_lines": q_statistics_lines,
    "statistics_documents": q_statistics_documents,
    "parquet_results": q_parquet_results,
    "csv_results": q_csv_results,
}
