"""Jobs that replay flows against fixed port maps (no per-day strategy file).

A fixed map is a handful of literal (port, probability) pairs, so it is a literal MAP
column looked up per row: no join and no broadcast at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlure import config
from flowlure.functions import flow_roll, place_by_ratio
from flowlure.operators.flows import attacker_flows, sample_sources
from flowlure.operators.ports import port_status_share, unused_hosts_per_port
from flowlure.operators.timeline import later_parts


def strategy_map(mapping: dict) -> Column:
    """Literal MAP<INT, DOUBLE> of a fixed strategy."""
    items = []
    for port, prob in sorted(mapping.items()):
        items += [F.lit(int(port)), F.lit(float(prob))]
    return F.create_map(*items)


def fixed_prob(mapping: dict, port="Dport") -> Column:
    """Probability of the fixed map for the row's port; NULL when the port is not in the map."""
    return F.try_element_at(strategy_map(mapping), F.col(port))


def _keep(df: DataFrame, name: str) -> DataFrame:
    return df


def fixed_strategy_daily_results(flows: DataFrame, strategy: dict | None = None, tag: str = "mixed",
                                 share: Callable[[DataFrame, str], DataFrame] = _keep, **thresholds) -> DataFrame:
    """Yearly replay of one fixed map; per day ``saved_count`` and ``hp_count``.

    * Candidate = flow not answered. Per (day, port) the candidate share is
      ``candidate hosts / distinct (host, status) pairs`` (``port_status_share``).
    * A candidate flow on a mapped port is a honeypot hit when ``share <= prob`` or its
      keyed roll (tag = ``tag``) is below ``prob / share``.
    * The first hit of a source is taken over the whole input period (not per day):
      ``min(ts)`` per source (map-side partial aggregate), matched back by the equi-join
      key (source, time), so no window holds a hot source.
    * ``saved_count``: pairs (first-hit row, later open-port flow of the same source and
      day); ``hp_count``: first-hit rows of the day. Days without a saved pair have no row.

    ``share(df, name)`` receives the intermediates read by several branches (attacker
    flows, first-hit rows); the plan layer passes a function that writes them once.
    """
    strategy = config.MIXED_STRATEGY if strategy is None else strategy
    att = share(attacker_flows(flows, share=share, **thresholds), "fixed-attacker-flows")
    shares = share(port_status_share(att).where(F.col("candidate"))
                   .select("day", "Dport", F.col("share").alias("ratio")), "fixed-shares")
    # Only candidates on mapped ports meet their share; equal rows count once.
    tried = att.where(~F.col("answered") & fixed_prob(strategy).isNotNull()).select("DstAddr", "Dport", "ts", "day", "SrcAddr")
    hp_rows = share(tried.join(shares, ["day", "Dport"])
                    .where(place_by_ratio("ratio", fixed_prob(strategy), flow_roll(tag)))
                    .select("DstAddr", "Dport", "ts", "day", "SrcAddr").distinct(), "fixed-hits")
    firsts = hp_rows.groupBy("SrcAddr").agg(F.min("ts").alias("ts"))
    first_hits = share(hp_rows.join(firsts, ["SrcAddr", "ts"], "left_semi"), "fixed-first-hits")
    open_rows = (att.where(F.col("answered")).select("DstAddr", "Dport", "State", "ts", "day", "SrcAddr").distinct()
                 .select("SrcAddr", "day", "ts"))
    per_hit = later_parts(first_hits, open_rows, ["SrcAddr", "day"], ["SrcAddr", "day", "DstAddr", "Dport", "ts"])
    saved = per_hit.groupBy("day").agg(F.sum("later").alias("saved_count"))
    hp_counts = first_hits.groupBy("day").agg(F.count("*").alias("hp_count"))
    return saved.join(hp_counts, "day").select("day", "saved_count", "hp_count")


def strategy_pair_comparison(flows: DataFrame, strategy_a: dict | None = None, strategy_b: dict | None = None,
                             rate: float = config.SOURCE_SAMPLE_RATE, seed=config.SAMPLE_SEED,
                             tags: tuple[str, str] = ("mixed", "always_on"),
                             share: Callable[[DataFrame, str], DataFrame] = _keep, **thresholds) -> DataFrame:
    """Two fixed maps side by side on a keyed sample of sources; per day the saved flows of each.

    Per day: attackers, unused hosts per port ``n`` and hosts of the day ``N`` are
    computed over the sampled sources; a flow on a mapped port is chosen when
    ``(n + 1) / N <= prob`` or its roll (tag per map) is below ``prob / ratio``; a hit
    needs the flow's port to be unused. Detection = first hit per (source, day);
    saved = open-port flows after it, counted as in ``count_after``, so a hot source is never
    one join partition. Every day of the unsampled ``flows`` has a row, 0 where nothing was
    saved. Output: day, saved_a, saved_b.
    """
    strategy_a = config.MIXED_STRATEGY if strategy_a is None else strategy_a
    strategy_b = config.ALWAYS_ON_STRATEGY if strategy_b is None else strategy_b
    att = share(attacker_flows(sample_sources(flows, rate, seed), share=share, **thresholds), "pair-attacker-flows")
    # A hit's port is unused, so the flows that matter have a ratio, and it is small.
    ratios = share(unused_hosts_per_port(att).select("day", "Dport", "ratio"), "pair-ratios")
    mapped = fixed_prob(strategy_a).isNotNull() | fixed_prob(strategy_b).isNotNull()
    scored = att.where(F.col("unused") & mapped).join(ratios, ["day", "Dport"])

    def hit(mapping, tag):
        prob = fixed_prob(mapping)
        return prob.isNotNull() & place_by_ratio("ratio", prob, flow_roll(tag))

    det = (scored.groupBy("SrcAddr", "day")
           .agg(F.min(F.when(hit(strategy_a, tags[0]), F.col("ts"))).alias("a"),
                F.min(F.when(hit(strategy_b, tags[1]), F.col("ts"))).alias("b")))
    marks = det.unpivot(["SrcAddr", "day"], ["a", "b"], "map", "ts").where(F.col("ts").isNotNull())
    open_flows = att.where(~F.col("unused")).select("SrcAddr", "day", "ts")
    later = later_parts(marks, open_flows, ["SrcAddr", "day"], ["SrcAddr", "day", "map"])
    saved = later.groupBy("day").agg(
        F.sum(F.when(F.col("map") == "a", F.col("later"))).alias("saved_a"),
        F.sum(F.when(F.col("map") == "b", F.col("later"))).alias("saved_b"))
    days = flows.where(F.col("day").isNotNull()).select("day").distinct()
    return (days.join(saved, "day", "left")
            .select("day", F.coalesce("saved_a", F.lit(0)).cast("bigint").alias("saved_a"),
                    F.coalesce("saved_b", F.lit(0)).cast("bigint").alias("saved_b")))
