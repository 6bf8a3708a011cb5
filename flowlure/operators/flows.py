"""Flow preparation, attackers and source sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlure import config
from flowlure.functions import answered, flow_day, flow_timestamp, keyed_sample, unused_port


def _keep(df: DataFrame, name: str) -> DataFrame:
    return df


def _prefixes(prefixes) -> tuple[str, ...]:
    return (prefixes,) if isinstance(prefixes, str) else tuple(prefixes)


def inside(col: str, prefixes) -> Column:
    """Address lies in the monitored network (any of the text prefixes)."""
    return reduce(lambda a, b: a | b, [F.col(col).startswith(p) for p in _prefixes(prefixes)])


def drop_repeated_rows(df: DataFrame, share=_keep) -> DataFrame:
    """Every distinct row once, NULLs equal to each other, without shuffling whole rows.

    Rows are counted by 128 bits of hash; the exchange carries those. Rows whose hash stands
    alone pass as they are. Only rows of repeated hashes are compared whole, after each task
    has dropped its own repeats, so rows that merely share a hash both stay. ``share(df, name)``
    may write the repeated hashes, so that the joins with them know their size.
    """
    nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in df.columns])
    columns = [F.col(f"`{c}`") for c in df.columns]
    hashed = df.withColumns({"_h1": F.xxhash64(nulls, *columns), "_h2": F.xxhash64(F.lit(1), nulls, *columns)})
    repeated = share(hashed.groupBy("_h1", "_h2").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("_h1", "_h2"), "repeated-hashes")
    alone = hashed.join(repeated, ["_h1", "_h2"], "left_anti").select(*columns)
    return alone.unionByName(hashed.join(repeated, ["_h1", "_h2"], "left_semi").select(*columns).dropDuplicates())


def prepare_flows(raw: DataFrame, prefixes=config.NETWORK_PREFIX_EVAL, drop_null_port: bool = False,
                  dedupe: bool = False, share=_keep, carried: tuple[str, ...] = ()) -> DataFrame:
    """Inbound TCP flows, typed, with state classes.

    Keeps ``Proto = 'tcp'``, destination inside and source outside the network. The
    prefix predicates are plain ``startswith`` so they reach a parquet scan as pushed
    filters. ``dedupe`` drops repeated raw rows first (:func:`drop_repeated_rows`);
    ``carried`` names further columns that pass unchanged.
    Output: SrcAddr, DstAddr, Dport INT (NULL when not a number), State,
    ts TIMESTAMP_NTZ, day DATE, unused BOOLEAN, answered BOOLEAN.
    """
    df = drop_repeated_rows(raw, share) if dedupe else raw
    df = df.where((F.col("Proto") == "tcp") & inside("DstAddr", prefixes) & ~inside("SrcAddr", prefixes))
    out = df.select(
        "SrcAddr", "DstAddr",
        F.col("Dport").try_cast("int").alias("Dport"),
        "State",
        flow_timestamp("StartTime").alias("ts"),
        flow_day("StartTime").alias("day"),
        unused_port("State").alias("unused"),
        answered("State").alias("answered"),
        *carried,
    )
    return out.where(F.col("Dport").isNotNull()) if drop_null_port else out


def daily_attackers(flows: DataFrame, min_hosts: int = config.MIN_ATTACKED_HOSTS,
                    min_ports: int = config.MIN_ATTACKED_PORTS) -> DataFrame:
    """Sources touching at least ``min_hosts`` hosts or ``min_ports`` ports on a day.

    Two exact distinct counts in one aggregate: Catalyst expands the rows once per
    distinct column and de-duplicates map side, so a hot source is spread over its
    distinct hosts/ports before the final (SrcAddr, day) count. NULL ports do not count.
    """
    return (flows.groupBy("SrcAddr", "day")
            .agg(F.count_distinct("DstAddr").alias("addr_count"),
                 F.count_distinct("Dport").alias("port_count"))
            .where((F.col("addr_count") >= min_hosts) | (F.col("port_count") >= min_ports)))


def attacker_flows(flows: DataFrame, attackers: DataFrame | None = None, share=_keep, **thresholds) -> DataFrame:
    """Flows of (source, day) attackers, as a left-semi join (no row multiplication).

    ``share(df, name)`` may write the attackers, one row per (source, day), and give back a
    reader: the plan of the join then knows their size in bytes, so they are broadcast below
    the session's threshold and the flows are not shuffled at all. Beyond it both sides are
    shuffled once, and AQE splits the flows of a source that holds too many of them.
    """
    if attackers is None:
        attackers = share(daily_attackers(flows, **thresholds).select("SrcAddr", "day"), "attackers")
    return flows.join(attackers.select("SrcAddr", "day"), ["SrcAddr", "day"], "left_semi")


def source_sample(flows: DataFrame, rate: float = config.SOURCE_SAMPLE_RATE,
                  seed=config.SAMPLE_SEED) -> DataFrame:
    """Keyed sample of distinct sources: each source is in with probability ``rate``.

    The filter runs before the de-duplication, so only sampled sources are shuffled.
    """
    return flows.where(keyed_sample("SrcAddr", rate, seed)).select("SrcAddr").distinct()


def sample_sources(flows: DataFrame, rate: float = config.SOURCE_SAMPLE_RATE,
                   seed=config.SAMPLE_SEED) -> DataFrame:
    """Flows of sampled sources (same test as :func:`source_sample`, no join needed)."""
    return flows.where(keyed_sample("SrcAddr", rate, seed))
