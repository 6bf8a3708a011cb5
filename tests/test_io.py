"""Readers and writers: strategy files (both shapes), statistics files, the flow archive."""

import contextlib
import io
import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlure.operators import daily_statistics_document, prepare_flows, strategy_long
from flowlure.plans import catalog
from flowlure.sources import (
    read_daily_statistics,
    read_flow_archive,
    read_statistics_document,
    read_statistics_lines,
    read_strategies,
    write_daily_statistics,
    write_statistics_lines,
    write_strategies,
)
from flowlure.sources.events import strategy_records_fixture


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_strategy_ndjson_round_trip(spark, scratch):
    records = strategy_records_fixture(catalog.eval_base(spark, SF_SMALL))
    path = os.path.join(scratch, "strategies")
    write_strategies(records, path)
    back = read_strategies(spark, path)
    assert _rows(strategy_long(back)) == _rows(strategy_long(records))


def test_strategy_document_with_port_maps(spark, scratch):
    doc = {"data": [
        {"date": "2016-09-29 00:00:00.0", "num_of_hp": 1.0, "rationality": 0.0, "reward": 0.15,
         "stg": {"80": 0.2, "22": 0.1, "8080": 0.7}, "used_hps": 1.0},
        {"date": "2016-09-29 00:00:00.0", "num_of_hp": 0.0, "rationality": 0.0, "reward": 0.0,
         "stg": {"80": 0.0, "22": 0.0, "8080": 0.0}, "used_hps": 0.0},
    ]}
    path = os.path.join(scratch, "doc.json")
    with open(path, "w") as fh:
        json.dump(doc, fh, indent=4)
    recs = read_strategies(spark, path, document=True)
    long = strategy_long(recs, rationality=0.0, num_of_hp=1.0).orderBy("port").collect()
    assert [(r.port, r.prob) for r in long] == [(22, 0.1), (80, 0.2), (8080, 0.7)]
    assert str(long[0].application_date) == "2016-09-30"


def test_statistics_document_reader(spark, scratch):
    doc = {"data": {
        "2021-03-04 00:00:00.0": {"attacker_strategy": {"23": 0.55, "2222": 0.05},
                                  "production_distribution": {"23": 0.25, "993": 0.125}},
        "2021-03-05:01.0.0": {"attacker_strategy": {"993": 1.0}, "production_distribution": {}},
        "2021-03-06": {"production_distribution": {"53": 0.375}},
    }, "metadata": {"note": "three days"}}
    path = os.path.join(scratch, "stats.json")
    with open(path, "w") as fh:
        json.dump(doc, fh, indent=2)
    rows = _rows(read_statistics_document(spark, path).select(F.col("day").cast("string"), "port",
                                                              "attack_probability", "open_port_probability"))
    assert rows == sorted([("2021-03-04", 23, 0.55, 0.25), ("2021-03-04", 2222, 0.05, 0.0), ("2021-03-04", 993, 0.0, 0.125),
                           ("2021-03-05", 993, 1.0, 0.0), ("2021-03-06", 53, 0.0, 0.375)], key=repr)


def test_daily_statistics_round_trips(spark, scratch):
    stats = catalog.stats(spark, SF_SMALL)
    path = os.path.join(scratch, "daily")
    write_daily_statistics(stats, path)
    assert _rows(read_daily_statistics(spark, path)) == _rows(stats)
    lines = os.path.join(scratch, "lines")
    write_statistics_lines(daily_statistics_document(stats), lines)
    back = spark.read.json(lines)
    assert back.count() == stats.select("day").distinct().count()
    assert {"day", "attacker_strategy", "production_distribution", "created"} <= set(back.columns)
    assert _rows(read_statistics_lines(spark, lines)) == _rows(stats.where("port IS NOT NULL"))


def test_no_day_chosen_reads_nothing(spark, scratch):
    catalog.raw_flows(spark, SF_SMALL).limit(5).withColumn("_yyyymd", F.lit("2024-1-2")).write.partitionBy("_yyyymd").parquet(f"{scratch}/a")
    assert read_flow_archive(spark, f"{scratch}/a", days=[]).count() == 0
    assert read_flow_archive(spark, f"{scratch}/a").count() == 5


def _explain(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_flow_archive_partition_pruning_and_pushdown(spark, scratch):
    raw = catalog.raw_flows(spark, SF_SMALL)
    root = os.path.join(scratch, "archive")
    (raw.withColumn("_yyyymd", F.date_format(F.to_date(F.substring("StartTime", 1, 10), "yyyy/MM/dd"), "yyyy-M-d"))
     .write.partitionBy("_yyyymd").parquet(root))
    days = ["2024-1-3", "2024-1-4"]
    flows = prepare_flows(read_flow_archive(spark, root, days=days), "147.32.8")
    plan = _explain(flows.select("SrcAddr", "Dport"))
    assert "PartitionFilters: [_yyyymd" in plan and "IN (2024-1-3,2024-1-4)" in plan
    assert "StringStartsWith(DstAddr,147.32.8)" in plan
    assert "EqualTo(Proto,tcp)" in plan
    assert "ReadSchema: struct<Proto:string,SrcAddr:string,DstAddr:string,Dport:string>" in plan
    expected = prepare_flows(raw, "147.32.8").where(F.col("day").isin("2024-01-03", "2024-01-04"))
    assert _rows(flows) == _rows(expected)
    ranged = read_flow_archive(spark, root, start="2024-01-03", end="2024-01-04")
    assert ranged.count() == read_flow_archive(spark, root, days=days).count()
    globbed = read_flow_archive(spark, root, days=["2024-1-1?"])  # days 10..19
    assert "PartitionFilters: [isnotnull(_yyyymd" in _explain(globbed) and "LIKE" in _explain(globbed).upper()
    assert globbed.count() == read_flow_archive(spark, root, days=[f"2024-1-{d}" for d in range(10, 20)]).count()
