"""End-to-end batch jobs: flow archive in, result files out.

Each job is one DataFrame lineage from the archive root (days chosen by partition filter)
to a sink. Where two branches of a job share an expensive intermediate (attacker flows
feed both the detection and the saved-flow branch), it is written once as parquet to the
shared checkpoint folder the cluster names in ``spark.checkpoint.dir`` and read back:
that cuts the lineage (a lost executor does not re-run the scan) and the re-read gets
column pruning and pushed filters.

Run from the command line: ``python -m flowlure.plans.jobs <job> --help``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlure import config
from flowlure.operators import (
    attack_probability_daily,
    attacker_flows,
    average_attackers_per_port,
    average_production_ratio,
    daily_port_statistics,
    daily_statistics_document,
    detections,
    fixed_strategy_daily_results,
    honeypot_assignment,
    open_port_probability_daily,
    port_hit_summary,
    prepare_flows,
    saved_flows,
    strategy_long,
    strategy_pair_comparison,
    strategy_setup_summary,
    strategy_sweep,
    sweep_records,
    top_attacked_ports,
)
from flowlure.plans.persist import ScratchTables
from flowlure.sources import (
    read_daily_statistics,
    read_flow_archive,
    read_statistics_document,
    read_statistics_lines,
    read_strategies,
    write_csv,
    write_daily_statistics,
    write_parquet,
    write_statistics_lines,
    write_strategies,
)


def _flows(spark, archive, days=None, start=None, end=None, prefix=config.NETWORK_PREFIX_WIDE,
           drop_null_port=False) -> DataFrame:
    return prepare_flows(read_flow_archive(spark, archive, days=days, start=start, end=end), prefix,
                         drop_null_port=drop_null_port)


NEW = "errorifexists"


def attack_probability_job(spark, archive, output, write_mode=NEW, **window):
    """Daily attack probability per port -> parquet."""
    with ScratchTables(spark) as keep:
        write_parquet(attack_probability_daily(_flows(spark, archive, **window), share=keep), output, write_mode)


def open_port_probability_job(spark, archive, output, write_mode=NEW, **window):
    """Daily open-port share per port -> parquet."""
    with ScratchTables(spark) as keep:
        write_parquet(open_port_probability_daily(_flows(spark, archive, **window), share=keep), output, write_mode)


def port_reports_job(spark, archive, output, limit=100, include_zero_days=False, write_mode=NEW, **window):
    """Top ports by mean daily attackers and by mean production share -> two CSV folders."""
    flows = _flows(spark, archive, **window)
    with ScratchTables(spark) as keep:
        attackers = average_attackers_per_port(flows, limit=limit, include_zero_days=include_zero_days, share=keep)
        write_csv(attackers, f"{output}/average_attackers", write_mode)
        write_csv(average_production_ratio(flows, limit=limit, share=keep), f"{output}/average_production_ratio", write_mode)


def daily_statistics_job(spark, archive, output, write_mode=NEW, **window):
    """Daily port statistics -> NDJSON records and per-day nested lines."""
    with ScratchTables(spark) as keep:
        stats = keep(daily_port_statistics(_flows(spark, archive, **window), share=keep), "daily-statistics")
        write_daily_statistics(stats, f"{output}/records", write_mode)
        write_statistics_lines(daily_statistics_document(stats), f"{output}/document", write_mode)


def _statistics(spark, path, document=False, lines=False) -> DataFrame:
    if document:
        return read_statistics_document(spark, path)
    return read_statistics_lines(spark, path) if lines else read_daily_statistics(spark, path)


def strategy_generation_job(spark, statistics, output, document=False, lines=False, write_mode=NEW, rationality_step=0.1,
                            max_honeypots=7.0, honeypot_step=1.0, top=config.TOP_PORTS,
                            rationalities=None, honeypots=None):
    """Statistics (NDJSON records, per-day lines or the nested document) -> strategy sweep -> NDJSON strategies.

    The grid is 0..1 by ``rationality_step`` x 0..``max_honeypots`` by ``honeypot_step``
    unless explicit ``rationalities`` / ``honeypots`` lists are given (e.g. one fixed point).
    """
    stats = _statistics(spark, statistics, document, lines)
    sweep = strategy_sweep(top_attacked_ports(stats, top), rationalities=rationalities, honeypots=honeypots,
                           rationality_step=rationality_step, max_honeypots=max_honeypots,
                           honeypot_step=honeypot_step)
    write_strategies(sweep_records(sweep), output, write_mode)


def strategy_evaluation_job(spark, archive, strategies, output, rationality=None, num_of_hp=None,
                            mode="prob", document=False, include_zero_days=False, write_mode=NEW, **window):
    """Replay the archive against a strategy file; per-setup mean/stddev of the saved ratio -> CSV.

    Also writes the per-(strategy, day) saved rows next to it (``<output>_daily``).
    ``document``: the strategies are a ``{"data": [...]}`` document with port maps.
    """
    flows = _flows(spark, archive, prefix=config.NETWORK_PREFIX_EVAL, drop_null_port=True, **window)
    strat = strategy_long(read_strategies(spark, strategies, document), rationality=rationality, num_of_hp=num_of_hp)
    with ScratchTables(spark) as keep:
        att = keep(attacker_flows(flows, share=keep), "attacker-flows")
        det = keep(detections(att, strat, mode=mode, share=keep), "detections")
        saved = keep(saved_flows(att, det), "saved-flows")
        write_csv(saved, f"{output}_daily", write_mode)
        open_days = att.where(~F.col("unused")).select("day").distinct() if include_zero_days else None
        write_csv(strategy_setup_summary(saved, strat, zero_days=open_days), output, write_mode)


def port_evaluation_job(spark, archive, strategies, output, rationality, num_of_hp, document=False,
                        include_zero_days=False, write_mode=NEW, **window):
    """Ports hit at detection time (ratio placement) for one setup -> CSV."""
    flows = _flows(spark, archive, prefix=config.NETWORK_PREFIX_EVAL, drop_null_port=True, **window)
    strat = strategy_long(read_strategies(spark, strategies, document), rationality=rationality, num_of_hp=num_of_hp)
    with ScratchTables(spark) as keep:
        att = keep(attacker_flows(flows, share=keep), "attacker-flows")
        assignment = honeypot_assignment(att, strat, mode="ratio", share=keep)
        write_csv(port_hit_summary(assignment, share=keep, include_zero_days=include_zero_days), output, write_mode)


def fixed_strategy_job(spark, archive, output, fixed_map="mixed", strategy=None, write_mode=NEW, **window):
    """Yearly replay of a fixed port map -> parquet (day, saved_count, hp_count).

    ``fixed_map`` names one of ``config.FIXED_MAPS`` and tags its rolls; ``strategy`` may replace the map.
    """
    strategy = config.FIXED_MAPS[fixed_map] if strategy is None else strategy
    with ScratchTables(spark) as keep:
        write_parquet(fixed_strategy_daily_results(_flows(spark, archive, **window), strategy=strategy, tag=fixed_map,
                                                   share=keep), output, write_mode)


def pair_comparison_job(spark, archive, output, rate=config.SOURCE_SAMPLE_RATE, write_mode=NEW, **window):
    """Mixed vs always-on fixed maps on a keyed source sample -> CSV per day."""
    flows = _flows(spark, archive, prefix=config.NETWORK_PREFIX_EVAL, **window)
    with ScratchTables(spark) as keep:
        write_csv(strategy_pair_comparison(flows, rate=rate, share=keep), output, write_mode)


JOBS = {
    "attack-probability": attack_probability_job,
    "open-port-probability": open_port_probability_job,
    "port-reports": port_reports_job,
    "daily-statistics": daily_statistics_job,
    "strategy-generation": strategy_generation_job,
    "strategy-evaluation": strategy_evaluation_job,
    "port-evaluation": port_evaluation_job,
    "fixed-strategy": fixed_strategy_job,
    "pair-comparison": pair_comparison_job,
}


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="flowlure.plans.jobs")
    ap.add_argument("job", choices=sorted(JOBS))
    ap.add_argument("--archive", help="flow archive root (partitioned by _yyyymd)")
    ap.add_argument("--strategies", help="strategy NDJSON file or folder")
    ap.add_argument("--statistics", help="statistics NDJSON (or --document for the nested form)")
    ap.add_argument("--document", action="store_true", help="the statistics or strategies file is one nested document")
    ap.add_argument("--lines", action="store_true", help="the statistics are per-day lines")
    ap.add_argument("--fixed-map", choices=sorted(config.FIXED_MAPS), default="mixed", help="map of the fixed replay")
    ap.add_argument("--include-zero-days", action="store_true", help="days without an event enter means as 0")
    ap.add_argument("--overwrite", action="store_true", help="replace an output that exists")
    ap.add_argument("--output", required=True)
    ap.add_argument("--days", help="comma list of partition values or globs, e.g. 2017-3-8,2017-3-9 or 2016-*")
    ap.add_argument("--start"), ap.add_argument("--end")
    ap.add_argument("--rationality", type=float), ap.add_argument("--num-of-hp", type=float)
    ap.add_argument("--rate", type=float, default=config.SOURCE_SAMPLE_RATE)
    ap.add_argument("--mode", choices=["prob", "ratio"], default="prob", help="placement rule for evaluation")
    ap.add_argument("--rationality-step", type=float, default=0.1)
    ap.add_argument("--max-honeypots", type=float, default=7.0)
    ap.add_argument("--honeypot-step", type=float, default=1.0)
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"flowlure-{a.job}").getOrCreate()
    write_mode = "overwrite" if a.overwrite else NEW
    window = {"write_mode": write_mode, "days": a.days.split(",") if a.days else None, "start": a.start, "end": a.end}
    job = a.job
    if job == "strategy-generation":
        strategy_generation_job(spark, a.statistics, a.output, document=a.document, lines=a.lines,
                                write_mode=write_mode, rationality_step=a.rationality_step, max_honeypots=a.max_honeypots,
                                honeypot_step=a.honeypot_step,
                                rationalities=[a.rationality] if a.rationality is not None else None,
                                honeypots=[a.num_of_hp] if a.num_of_hp is not None else None)
    elif job == "strategy-evaluation":
        strategy_evaluation_job(spark, a.archive, a.strategies, a.output, a.rationality, a.num_of_hp,
                                mode=a.mode, document=a.document, include_zero_days=a.include_zero_days, **window)
    elif job == "port-evaluation":
        port_evaluation_job(spark, a.archive, a.strategies, a.output, a.rationality, a.num_of_hp,
                            document=a.document, include_zero_days=a.include_zero_days, **window)
    elif job == "fixed-strategy":
        fixed_strategy_job(spark, a.archive, a.output, fixed_map=a.fixed_map, **window)
    elif job == "port-reports":
        port_reports_job(spark, a.archive, a.output, include_zero_days=a.include_zero_days, **window)
    elif job == "pair-comparison":
        pair_comparison_job(spark, a.archive, a.output, rate=a.rate, **window)
    else:
        JOBS[job](spark, a.archive, a.output, **window)


if __name__ == "__main__":
    main()
