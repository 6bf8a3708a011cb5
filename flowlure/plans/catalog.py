"""The registered queries: one per composite operator, each over the whole test tables.

Every query derives flows from ``events`` (``sources.events``), so its work grows with
the table. Doubles that come out of sums or averages of doubles are rounded to 9 places,
in these queries and in their SQL oracle alike, because summation order differs between
engines; ratios of two counts are exact and stay unrounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlure import config
from flowlure.operators import (
    attack_probability_daily,
    attacker_flows,
    average_attackers_per_port,
    average_production_ratio,
    daily_attackers,
    daily_port_statistics,
    daily_statistics_document,
    detections,
    fixed_strategy_daily_results,
    honeypot_assignment,
    open_port_probability_daily,
    port_hit_summary,
    port_status_share,
    prepare_flows,
    production_ratio_daily,
    saved_flows,
    source_sample,
    strategy_long,
    strategy_pair_comparison,
    strategy_parameter_grid,
    strategy_scoring,
    strategy_setup_summary,
    strategy_sweep,
    sweep_certificate,
    top_attacked_ports,
    unused_hosts_per_port,
)
from flowlure.plans.persist import materialize
from flowlure.sources.events import (
    EVENTS_SCHEMA,
    flows_from_events,
    scattered_flows_from_events,
    scattered_strategy_records,
    strategy_records_fixture,
)

ROUND = 9
# Source sampling rate of the registered pair comparison: the test tables hold ~135
# sources, so the original 1 % would sample one or two.
PAIR_SAMPLE_RATE = 0.5
# Places that a reward keeps in the certificate (solver and SQL agree to far more).
REWARD_ROUND = 6
# Setup replayed by the port-hit summary (the original job takes exactly one setup).
HIT_SUMMARY_SETUP = (0.8, 2.0)


def _r(col: str):
    return F.round(F.col(col), ROUND).alias(col)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def raw_flows(spark, sf_dir) -> DataFrame:
    return flows_from_events(events(spark, sf_dir))


def wide_flows(spark, sf_dir) -> DataFrame:
    """Statistics-job flows: prefix 147.32., NULL ports kept."""
    return prepare_flows(raw_flows(spark, sf_dir), config.NETWORK_PREFIX_WIDE)


def eval_base(spark, sf_dir) -> DataFrame:
    """Evaluation-job flows: prefix 147.32.8, NULL ports kept."""
    return prepare_flows(raw_flows(spark, sf_dir), config.NETWORK_PREFIX_EVAL)


def without_null_ports(flows: DataFrame) -> DataFrame:
    return flows.where(F.col("Dport").isNotNull())


def eval_flows(spark, sf_dir) -> DataFrame:
    """Evaluation-job flows with NULL ports dropped."""
    return without_null_ports(eval_base(spark, sf_dir))


def shared(flows: DataFrame) -> DataFrame:
    """Typed flows that several branches of a query read (attackers, their flows, days), written once."""
    return materialize(flows, "flows")


def strategies_from(base: DataFrame) -> DataFrame:
    return strategy_long(strategy_records_fixture(base))


def stats(spark, sf_dir) -> DataFrame:
    # All branches of the statistics read one written table of distinct tuples.
    return daily_port_statistics(wide_flows(spark, sf_dir), share=materialize)


def q_prepared_flows(spark, sf):
    return eval_base(spark, sf)


def q_daily_attackers(spark, sf):
    return daily_attackers(eval_flows(spark, sf))


def q_attacker_flows(spark, sf):
    return attacker_flows(shared(eval_flows(spark, sf)), share=materialize)


def q_attack_probability_daily(spark, sf):
    return attack_probability_daily(wide_flows(spark, sf), share=materialize)


def q_average_attackers_per_port(spark, sf):
    return average_attackers_per_port(wide_flows(spark, sf), share=materialize)


def q_open_port_probability_daily(spark, sf):
    return open_port_probability_daily(wide_flows(spark, sf), share=materialize)


def q_production_ratio_daily(spark, sf):
    return production_ratio_daily(wide_flows(spark, sf), share=materialize)


def q_average_production_ratio(spark, sf):
    return average_production_ratio(wide_flows(spark, sf), share=materialize).select("Dport", _r("average_ratio"))


def q_daily_port_statistics(spark, sf):
    return stats(spark, sf)


def q_daily_statistics_document(spark, sf):
    doc = daily_statistics_document(stats(spark, sf))
    return doc.select("day", "ports", F.to_json("attacker_strategy").alias("attacker_strategy"),
                      F.to_json("production_distribution").alias("production_distribution"))


def q_strategy_long(spark, sf):
    return strategies_from(eval_base(spark, sf))


def q_unused_hosts_per_port(spark, sf):
    return unused_hosts_per_port(attacker_flows(shared(eval_flows(spark, sf)), share=materialize))


def q_port_status_share(spark, sf):
    return port_status_share(attacker_flows(shared(wide_flows(spark, sf)), share=materialize))


def _evaluation(spark, sf, setup=None):
    """(attacker flows, strategies) over one written table of typed flows."""
    base = shared(eval_base(spark, sf))
    att = attacker_flows(without_null_ports(base), share=materialize)
    strat = strategies_from(base)
    if setup is not None:
        strat = strat.where((F.round("rationality", 6) == setup[0]) & (F.round("num_of_hp", 6) == setup[1]))
    return att, strat


def q_honeypot_assignment(spark, sf):
    return honeypot_assignment(*_evaluation(spark, sf), share=materialize)


def q_first_detection(spark, sf):
    att, strat = _evaluation(spark, sf)
    return detections(att, strat, share=materialize)


def q_saved_flows(spark, sf):
    att, strat = _evaluation(spark, sf)
    return saved_flows(att, materialize(detections(att, strat, share=materialize), "detections"))


def q_strategy_setup_summary(spark, sf):
    att, strat = _evaluation(spark, sf)
    saved = saved_flows(att, materialize(detections(att, strat, share=materialize), "detections"))
    return strategy_setup_summary(saved, strat).select("rationality", "num_of_hp", _r("avg_saved_ratio"), _r("stddev"))


def q_port_hit_summary(spark, sf):
    att, strat = _evaluation(spark, sf, setup=HIT_SUMMARY_SETUP)
    hits = port_hit_summary(honeypot_assignment(att, strat, mode="ratio", share=materialize), share=materialize)
    return hits.select("Dport", _r("avg_hit"), _r("stddev"))


def q_fixed_strategy_daily_results(spark, sf):
    return fixed_strategy_daily_results(shared(wide_flows(spark, sf)), share=materialize)


def q_strategy_pair_comparison(spark, sf):
    return strategy_pair_comparison(shared(eval_base(spark, sf)), rate=PAIR_SAMPLE_RATE, share=materialize)


def q_source_sample(spark, sf):
    return source_sample(eval_base(spark, sf), rate=PAIR_SAMPLE_RATE)


def q_top_attacked_ports(spark, sf):
    return top_attacked_ports(stats(spark, sf))


def q_strategy_parameter_grid(spark, sf):
    return strategy_parameter_grid(stats(spark, sf))


def q_strategy_scoring(spark, sf):
    scored = strategy_scoring(strategies_from(eval_base(spark, sf)), stats(spark, sf))
    return scored.select("strategy_id", "day", "rationality", "num_of_hp", "ports", _r("reward"),
                         _r("used_hps"), "feasible")


def q_strategy_sweep(spark, sf):
    sweep = strategy_sweep(top_attacked_ports(stats(spark, sf)))
    return sweep.select("day", "rationality", "num_of_hp", _r("reward"), _r("used_hps"), "feasible",
                        "port", _r("prob"))


def scattered_flows(spark, sf) -> DataFrame:
    """Flows over many ports (``scattered_flows_from_events``): limits cut, shares stay under 1."""
    return prepare_flows(scattered_flows_from_events(events(spark, sf)), config.NETWORK_PREFIX_WIDE)


def scattered_stats(spark, sf) -> DataFrame:
    return daily_port_statistics(scattered_flows(spark, sf), share=materialize)


def q_scattered_top_ports(spark, sf):
    return top_attacked_ports(scattered_stats(spark, sf))


def q_scattered_average_attackers(spark, sf):
    return average_attackers_per_port(scattered_flows(spark, sf), share=materialize).select("Dport", _r("average_count"))


def q_scattered_average_production(spark, sf):
    return average_production_ratio(scattered_flows(spark, sf), share=materialize).select("Dport", _r("average_ratio"))


def q_scattered_scoring(spark, sf):
    strategies = strategy_long(scattered_strategy_records(scattered_flows(spark, sf)))
    # A strategy is scored against the day before it applies; its fixture days are those of the flows.
    scored = strategy_scoring(strategies.withColumn("application_date", F.date_add("application_date", 1)), scattered_stats(spark, sf))
    return scored.select("strategy_id", "day", "rationality", "num_of_hp", "ports", _r("reward"), _r("used_hps"), "feasible")


def q_strategy_sweep_certified(spark, sf):
    top = materialize(top_attacked_ports(scattered_stats(spark, sf)), "top-ports")
    checked = sweep_certificate(strategy_sweep(top), top)
    # At rationality 0 and 1 the reward has a closed form, which the SQL computes by itself.
    edge = F.col("feasible") & F.col("rationality").isin(0.0, 1.0)
    return checked.select("day", "rationality", "num_of_hp", "ports", "feasible", "certified",
                          F.when(edge, F.round("reward", REWARD_ROUND)).alias("edge_reward"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "prepared_flows": q_prepared_flows,
    "daily_attackers": q_daily_attackers,
    "attacker_flows": q_attacker_flows,
    "attack_probability_daily": q_attack_probability_daily,
    "average_attackers_per_port": q_average_attackers_per_port,
    "open_port_probability_daily": q_open_port_probability_daily,
    "production_ratio_daily": q_production_ratio_daily,
    "average_production_ratio": q_average_production_ratio,
    "daily_port_statistics": q_daily_port_statistics,
    "daily_statistics_document": q_daily_statistics_document,
    "strategy_long": q_strategy_long,
    "unused_hosts_per_port": q_unused_hosts_per_port,
    "port_status_share": q_port_status_share,
    "honeypot_assignment": q_honeypot_assignment,
    "first_detection": q_first_detection,
    "saved_flows": q_saved_flows,
    "strategy_setup_summary": q_strategy_setup_summary,
    "port_hit_summary": q_port_hit_summary,
    "fixed_strategy_daily_results": q_fixed_strategy_daily_results,
    "strategy_pair_comparison": q_strategy_pair_comparison,
    "source_sample": q_source_sample,
    "top_attacked_ports": q_top_attacked_ports,
    "strategy_parameter_grid": q_strategy_parameter_grid,
    "strategy_scoring": q_strategy_scoring,
    "strategy_sweep": q_strategy_sweep,
    "strategy_sweep_certified": q_strategy_sweep_certified,
    "scattered_top_ports": q_scattered_top_ports,
    "scattered_average_attackers": q_scattered_average_attackers,
    "scattered_average_production": q_scattered_average_production,
    "scattered_scoring": q_scattered_scoring,
}
