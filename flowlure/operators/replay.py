"""Counterfactual replay of flows against honeypot strategies.

For each strategy (a probability per port, applied on one day) every unused-port flow of
an attacker gets a keyed roll; the flow hits a honeypot when the placement rule holds.
The earliest hit per (source, strategy, day) is the detection; open-port flows of that
source after the detection are "saved".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlure import config
from flowlure.functions import flow_roll, place_by_probability, place_by_ratio
from flowlure.operators.ports import unused_hosts_per_port
from flowlure.operators.timeline import later_parts, minute_of_day


def _round(c, digits=config.GRID_DECIMALS):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def strategy_long(records: DataFrame, rationality: float | None = None,
                  num_of_hp: float | None = None) -> DataFrame:
    """Strategy records -> one row per (strategy, port).

    ``strategy_id`` = ``date_numOfHp_rationality``; ``application_date`` = date + 1 (the
    date is the first 10 characters of the record's date text). Optional setup filters
    compare values rounded to 6 places, so grid values such as 0.30000000000000004 match.
    Output: strategy_id, application_date, rationality, num_of_hp, port, prob.
    """
    rec = records
    if rationality is not None:
        rec = rec.where(_round("rationality") == round(float(rationality), config.GRID_DECIMALS))
    if num_of_hp is not None:
        rec = rec.where(_round("num_of_hp") == round(float(num_of_hp), config.GRID_DECIMALS))
    date = F.substring("date", 1, 10).try_cast("date")
    sid = F.concat_ws("_", F.col("date"), F.col("num_of_hp").cast("string"), F.col("rationality").cast("string"))
    return rec.select(sid.alias("strategy_id"), F.date_add(date, 1).alias("application_date"),
                      "rationality", "num_of_hp", F.inline("stg"))


def strategies_by_port(strategies: DataFrame) -> DataFrame:
    """(day, Dport, setups): the strategies that list a port on a day, as one array of (strategy_id, prob).

    An array holds one entry per strategy of the day at most, however many flows there are.
    """
    return (strategies.where(F.col("application_date").isNotNull() & F.col("port").isNotNull())
            .groupBy(F.col("application_date").alias("day"), F.col("port").alias("Dport"))
            .agg(F.collect_list(F.struct("strategy_id", "prob")).alias("setups")))


def honeypot_assignment(att_flows: DataFrame, strategies: DataFrame, mode: str = "prob",
                        seed: str = config.ROLL_SEED, share=lambda df, name: df) -> DataFrame:
    """Each unused-port attacker flow x each strategy of its day listing its port, with ``is_hp``.

    ``mode='prob'``: ``roll <= prob``. ``mode='ratio'``: ``ratio <= prob`` or
    ``roll < prob / ratio`` with ``ratio = (unused hosts on the port + 1) / hosts of the day``.
    The roll is keyed by the flow only, so all strategies share it (and it survives
    re-execution). The flows meet one row per (day, port), which holds the ratio and all
    strategies of the port; the fan-out over strategies comes after that join, without a
    shuffle. ``share(df, name)`` may write those rows, so that the join knows their size.
    Output: SrcAddr, DstAddr, Dport, ts, day, strategy_id, prob, roll[, ratio], is_hp.
    """
    placed, rule, extra = _with_setups(_rolled(att_flows, seed), att_flows, strategies, mode, share)
    rows = placed.select("SrcAddr", "DstAddr", "Dport", "ts", "day", "roll", *extra, F.inline("setups"))
    return rows.select("SrcAddr", "DstAddr", "Dport", "ts", "day", "strategy_id", "prob", "roll", *extra,
                       rule(F.col("prob")).alias("is_hp"))


def _rolled(att_flows: DataFrame, seed: str) -> DataFrame:
    return att_flows.where(F.col("unused")).select(
        "SrcAddr", "DstAddr", "Dport", "ts", "day", flow_roll(seed).alias("roll"))


def _with_setups(cand: DataFrame, att_flows: DataFrame, strategies: DataFrame, mode: str, share):
    """(candidates with the setups of their (day, port), rule of a probability, further columns)."""
    setups = strategies_by_port(strategies)
    if mode == "prob":
        rule, extra = (lambda prob: place_by_probability("roll", prob)), []
    elif mode == "ratio":
        setups = setups.join(unused_hosts_per_port(att_flows).select("day", "Dport", "ratio"), ["day", "Dport"])
        rule, extra = (lambda prob: place_by_ratio("ratio", prob, "roll")), ["ratio"]
    else:
        raise ValueError(f"unknown placement mode {mode!r}")
    return cand.join(share(setups, "setups"), ["day", "Dport"]), rule, extra


def record_low_flows(candidates: DataFrame, keys=("SrcAddr", "day", "Dport"), share=lambda df, name: df) -> DataFrame:
    """Flows whose roll is below every roll seen earlier in their (source, day, port).

    A first hit under any threshold rule that is fixed per (day, port, strategy) (``roll
    <= prob``, or ``ratio <= prob`` / ``roll < prob / ratio``) is always such a flow: an
    earlier flow with a roll no higher would qualify too. Exact, in two levels so no
    window holds a hot group: record lows within each minute of the day (the only shuffle
    of the candidates), then only those below the minimum roll of all earlier minutes (a
    window over per-minute minima, at most 1,440 rows per group; the minimum of a minute is
    always one of its record lows). Rows with a NULL time are kept. ``share(df, name)`` may
    write the record lows of the minutes, which the floors and the result both read.
    """
    keys = list(keys)
    # Explicit exchange on all window keys: a window accepts a partitioning on a subset of
    # its keys, so after a shuffle join on (source, day) it would otherwise run per
    # (source, day) and a hot source would be one task.
    cand = candidates.withColumn("_m", minute_of_day(F.col("ts"))).repartition(*keys, "_m")
    within = Window.partitionBy(*keys, "_m").orderBy("ts", "roll").rowsBetween(Window.unboundedPreceding, -1)
    local = (cand.withColumn("_prev", F.min("roll").over(within))
             .where(F.col("ts").isNull() | F.col("_prev").isNull() | (F.col("roll") < F.col("_prev")))
             .drop("_prev"))
    local = share(local, "record-lows")
    per_minute = local.where(F.col("_m").isNotNull()).groupBy(*keys, "_m").agg(F.min("roll").alias("_mr"))
    earlier = Window.partitionBy(*keys).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    floors = per_minute.select(*keys, "_m", F.min("_mr").over(earlier).alias("_floor"))
    return (local.join(floors, [*keys, "_m"], "left")
            .where(F.col("_floor").isNull() | (F.col("roll") < F.col("_floor")))
            .drop("_m", "_floor"))


def detections(att_flows: DataFrame, strategies: DataFrame, mode: str = "prob",
               seed: str = config.ROLL_SEED, share=lambda df, name: df) -> DataFrame:
    """First hit per (source, strategy, day), equal to ``first_detection(honeypot_assignment(...))``.

    The strategy fan-out runs over :func:`record_low_flows` only, so a source with many
    flows on a port contributes about log(n) rows per minute instead of n rows per strategy.
    """
    cand = record_low_flows(_rolled(att_flows, seed), share=share)
    placed, rule, _ = _with_setups(cand, att_flows, strategies, mode, share)
    hits = placed.select("SrcAddr", "ts", "day", F.inline(F.filter("setups", lambda s: rule(s["prob"]))))
    return first_detection(hits.withColumn("is_hp", F.lit(True)))


def first_detection(assignment: DataFrame) -> DataFrame:
    """Earliest honeypot hit per (source, strategy, day).

    The ``is_hp`` filter is pushed into the strategy join condition, so misses are never
    materialised; ``min`` aggregates map side before the shuffle (hot sources collapse).
    Output: SrcAddr, strategy_id, day, detection_time.
    """
    return (assignment.where(F.col("is_hp"))
            .groupBy("SrcAddr", "strategy_id", "day")
            .agg(F.min("ts").alias("detection_time")))


def saved_flows(att_flows: DataFrame, detections: DataFrame) -> DataFrame:
    """Per (strategy, day): open-port attacker flows strictly after the source's detection.

    ``total_attacks`` counts all open-port attacker flows of the day. Strategies with no
    saved flow on a day have no row. The counts are those of ``count_after``: flows are
    added up per source and time before they are shuffled, and a source with many flows is
    not paired with every strategy flow by flow.
    Output: strategy_id, day, saved, total_attacks, saved_ratio.
    """
    open_flows = att_flows.where(~F.col("unused")).select("SrcAddr", "day", "ts")
    totals = open_flows.groupBy("day").agg(F.count("*").alias("total_attacks"))
    per_detection = later_parts(detections, open_flows, ["SrcAddr", "day"],
                                ["SrcAddr", "day", "strategy_id"], mark_time="detection_time")
    saved = per_detection.groupBy("strategy_id", "day").agg(F.sum("later").alias("saved"))
    return (saved.join(totals, "day")
            .select("strategy_id", "day", "saved", "total_attacks",
                    (F.col("saved") / F.col("total_attacks")).alias("saved_ratio")))


def strategy_setup_summary(saved: DataFrame, strategies: DataFrame, zero_days: DataFrame | None = None) -> DataFrame:
    """Mean and sample standard deviation of ``saved_ratio`` per (rationality, num_of_hp).

    Only days with a saved row enter the mean, or with ``zero_days`` (distinct ``day``) also
    those days, as 0, on which a strategy applied and saved nothing. stddev is NULL for a
    single day.
    """
    setups = strategies.select("strategy_id", "rationality", "num_of_hp").distinct()
    if zero_days is not None:
        applied = strategies.select("strategy_id", F.col("application_date").alias("day")).distinct().join(zero_days, "day")
        saved = (applied.join(saved.select("strategy_id", "day", "saved_ratio"), ["strategy_id", "day"], "left")
                 .withColumn("saved_ratio", F.coalesce("saved_ratio", F.lit(0.0))))
    return (saved.join(setups, "strategy_id")
            .groupBy("rationality", "num_of_hp")
            .agg(F.avg("saved_ratio").alias("avg_saved_ratio"),
                 F.stddev_samp("saved_ratio").alias("stddev")))


def port_hit_summary(assignment: DataFrame, detections: DataFrame | None = None,
                     share=lambda df, name: df, include_zero_days: bool = False) -> DataFrame:
    """Per port: hits at the moment of detection counted per day; mean and stddev over days.

    All assigned flows at the detection time count (ties included). The match is an
    equi-join on (source, strategy, day, time), so a hot source spreads over its times.
    ``share(df, name)`` receives the hit rows, read twice (detection and match). Days without
    a hit on the port do not count, or with ``include_zero_days`` count as 0 (days of the
    assignment).
    Output: Dport, avg_hit, stddev (sorted by avg_hit descending).
    """
    hp = share(assignment.where(F.col("is_hp")).select("SrcAddr", "strategy_id", "day", "ts", "Dport"), "hit-rows")
    if detections is None:
        detections = first_detection(hp.withColumn("is_hp", F.lit(True)))
    hits = hp.join(
        detections.withColumnRenamed("detection_time", "ts"), ["SrcAddr", "strategy_id", "day", "ts"], "left_semi")
    per_day = hits.groupBy("Dport", "day").agg(F.count("*").alias("hit"))
    if include_zero_days:
        days = assignment.select("day").distinct().agg(F.count("*").alias("n"))
        sums = per_day.groupBy("Dport").agg(F.sum("hit").alias("s"), F.sum(F.col("hit") * F.col("hit")).alias("q"))
        n, s = F.col("n"), F.col("s")
        return (sums.join(F.broadcast(days))  # one row: a scalar for every port
                .select("Dport", (s / n).alias("avg_hit"),
                        F.when(n > 1, F.sqrt((F.col("q") - s * s / n) / (n - 1))).alias("stddev"))
                .orderBy(F.col("avg_hit").desc(), F.col("Dport").asc()))
    return (per_day.groupBy("Dport")
            .agg(F.avg("hit").alias("avg_hit"), F.stddev_samp("hit").alias("stddev"))
            .orderBy(F.col("avg_hit").desc(), F.col("Dport").asc()))
