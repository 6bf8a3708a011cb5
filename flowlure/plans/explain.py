"""Physical plans of the main pipelines over a partitioned flow archive.

``python -m flowlure.plans.explain <events sf dir> <scratch dir>`` builds a
small archive (partitioned by ``_yyyymd``) from the events table and prints, per
pipeline, the plan tree and the scan lines (partition filters, pushed filters, read schema).
"""

from __future__ import annotations

import contextlib
import io
import re
import sys

from pyspark.sql import functions as F

from flowlure import config
from flowlure.operators import (
    attack_probability_daily,
    attacker_flows,
    daily_port_statistics,
    detections,
    fixed_strategy_daily_results,
    prepare_flows,
    saved_flows,
    strategy_pair_comparison,
    strategy_sweep,
    top_attacked_ports,
)
from flowlure.plans import catalog
from flowlure.sources import read_flow_archive
from flowlure.sources.events import strategy_records_fixture
from flowlure.operators.replay import strategy_long


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    tree, _, details = text.partition("\n\n\n")
    scans = [re.sub(r"#\d+L?", "", ln) for ln in details.splitlines()
             if ln.startswith(("PartitionFilters", "PushedFilters", "ReadSchema"))]
    return tree.strip() + "\n\n" + "\n".join(sorted(set(scans)))


def pipelines(spark, archive: str):
    days = ["2024-1-2", "2024-1-3", "2024-1-4"]
    wide = prepare_flows(read_flow_archive(spark, archive, days=days), config.NETWORK_PREFIX_WIDE)
    narrow = prepare_flows(read_flow_archive(spark, archive, days=days), config.NETWORK_PREFIX_EVAL,
                           drop_null_port=True)
    att = attacker_flows(narrow)
    strat = strategy_long(strategy_records_fixture(narrow))
    det = detections(att, strat)
    yield "attack probability per day and port", attack_probability_daily(wide)
    yield "daily port statistics", daily_port_statistics(wide)
    yield "first detection (record lows, strategy fan-out)", det
    yield "saved flows (minute pre-aggregation)", saved_flows(att, det)
    yield "fixed-map yearly replay", fixed_strategy_daily_results(wide)
    yield "pair comparison on a keyed source sample", strategy_pair_comparison(narrow, rate=0.5)
    yield "strategy sweep", strategy_sweep(top_attacked_ports(daily_port_statistics(wide)))


def main(argv=None) -> None:
    from flowlure.session import local_session

    argv = argv or sys.argv[1:]
    sf_dir, scratch = argv[0], argv[1]
    spark = local_session()
    archive = f"{scratch}/archive"
    raw = catalog.raw_flows(spark, sf_dir)
    day = F.date_format(F.to_date(F.substring("StartTime", 1, 10), "yyyy/MM/dd"), "yyyy-M-d")
    raw.withColumn("_yyyymd", day).write.mode("overwrite").partitionBy("_yyyymd").parquet(archive)
    print("# Physical plans over a partitioned flow archive\n")
    print("Generated by `python -m flowlure.plans.explain`; three day partitions selected, AQE on.")
    print("Plans are the initial AQE plans: broadcasts marked here are decided again at run time")
    print("from measured sizes.\n")
    for title, df in pipelines(spark, archive):
        print(f"## {title}\n\n```\n{_plan(df)}\n```\n")


if __name__ == "__main__":
    main()
