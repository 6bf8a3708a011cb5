"""From daily port statistics to honeypot strategies (the allocation game) and their scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlure import config

SWEEP_SCHEMA = T.StructType([
    T.StructField("day", T.DateType()),
    T.StructField("rationality", T.DoubleType()),
    T.StructField("num_of_hp", T.DoubleType()),
    T.StructField("reward", T.DoubleType()),
    T.StructField("used_hps", T.DoubleType()),
    T.StructField("feasible", T.BooleanType()),
    T.StructField("port", T.IntegerType()),
    T.StructField("prob", T.DoubleType()),
    T.StructField("multiplier", T.DoubleType()),
    T.StructField("weight", T.DoubleType()),
])
#: Relative gap between a reward and its proven bound up to which it counts as optimal.
CERTIFIED_GAP = 1e-6


def grid_values(stop: float, step: float, decimals: int = config.GRID_DECIMALS) -> list[float]:
    """Inclusive float range 0, step, ..., stop, each value rounded (0.1 * 3 -> 0.3)."""
    if step <= 0:
        raise ValueError("step must be positive")
    count = int(np.floor(stop / step + 1e-9))
    return [round(i * step, decimals) for i in range(count + 1)]


def _grid_rows(rationalities, honeypots):
    """Generator expanding the literal grid into (rationality, num_of_hp) columns."""
    items = ", ".join(f"named_struct('rationality', {float(r)!r}D, 'num_of_hp', {float(h)!r}D)"
                      for r in rationalities for h in honeypots)
    return F.expr(f"inline(array({items}))")


def strategy_parameter_grid(stats: DataFrame, rationality_step: float = 0.1, max_honeypots: float = 7.0,
                            honeypot_step: float = 1.0, rationalities=None, honeypots=None) -> DataFrame:
    """Every day of the statistics x rationality grid x budget grid.

    The grid is a literal array expanded by a generator per day: no join. Defaults follow
    the documented sweep (rationality 0..1 by 0.1, budget 0..7 by 1).
    Output: day, rationality, num_of_hp.
    """
    rats = rationalities if rationalities is not None else grid_values(1.0, rationality_step)
    hps = honeypots if honeypots is not None else grid_values(max_honeypots, honeypot_step)
    return stats.select("day").distinct().select("day", _grid_rows(rats, hps))


def top_attacked_ports(stats: DataFrame, num: int = config.TOP_PORTS) -> DataFrame:
    """The ``num`` most attacked ports of each day (ties: lower port first).

    ``row_number() <= num`` plans as a per-partition group limit before the shuffle, so
    no task ever holds more than ``num`` rows of a day from each input partition.
    Output: day, port, attack_probability, open_port_probability, rank.
    """
    order = Window.partitionBy("day").orderBy(F.col("attack_probability").desc(), F.col("port").asc())
    return (stats.where(F.col("port").isNotNull())
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= num))


def strategy_scoring(strategies: DataFrame, stats: DataFrame,
                     hmin: float = config.MIN_HONEYPOT_SHARE) -> DataFrame:
    """Score strategy rows against the statistics of the strategy's own date (day before use).

    ``reward = rat * max(s/h) + (1 - rat) * sum(p s / h)`` over the strategy's ports (p, s
    of a port missing from the statistics count 0), ``used_hps = sum h`` and ``feasible``
    when every ``h >= hmin``, ``h <= 1 - s`` and ``sum h <= num_of_hp``.
    Output: strategy_id, day, rationality, num_of_hp, ports, reward, used_hps, feasible.
    """
    rows = strategies.select("strategy_id", F.date_sub("application_date", 1).alias("day"),
                             "rationality", "num_of_hp", "port", F.col("prob").alias("h"))
    st = stats.select("day", "port", F.col("attack_probability").alias("p"),
                      F.col("open_port_probability").alias("s"))
    j = rows.join(st, ["day", "port"], "left").select(
        "strategy_id", "day", "rationality", "num_of_hp", "h",
        F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("s", F.lit(0.0)).alias("s"))
    agg = j.groupBy("strategy_id", "day", "rationality", "num_of_hp").agg(
        F.count("*").alias("ports"),
        F.max(F.try_divide("s", "h")).alias("max_ratio"),
        F.sum(F.try_divide(F.col("p") * F.col("s"), F.col("h"))).alias("expected"),
        F.sum("h").alias("used_hps"),
        F.min("h").alias("min_h"),
        F.max(F.col("h") + F.col("s")).alias("max_cap"))
    rat = F.col("rationality")
    return agg.select(
        "strategy_id", "day", "rationality", "num_of_hp", "ports",
        (rat * F.col("max_ratio") + (F.lit(1.0) - rat) * F.col("expected")).alias("reward"),
        "used_hps",
        ((F.col("min_h") >= hmin) & (F.col("max_cap") <= 1.0 + 1e-9)
         & (F.col("used_hps") <= F.col("num_of_hp") + 1e-9)).alias("feasible"))


def _group_solver(hmin: float, budgets: list[float]):
    """The per-(day, rationality) pandas function, shipped to Python workers by value.

    It solves every budget of the grid for the group's ports (at most ``TOP_PORTS`` rows
    in, ``len(budgets) x ports`` rows out). The solver module is registered for pickling
    by value, so workers need numpy and pandas only, not this package on their path.
    """
    from pyspark import cloudpickle

    from flowlure.operators import allocation

    cloudpickle.register_pickle_by_value(allocation)
    solve, certify = allocation.solve_allocation, allocation.certificate
    budgets = [float(b) for b in budgets]

    def solve_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("port")
        rat = float(pdf["rationality"].iloc[0])
        p = pdf["attack_probability"].to_numpy(float)
        s = pdf["open_port_probability"].to_numpy(float)
        day, port = pdf["day"].to_numpy(), pdf["port"].astype("int32").to_numpy()
        parts = []
        for budget in budgets:
            h, reward, used, feasible = solve(p, s, budget, rat, hmin)
            multiplier, weight = certify(p, s, h, budget, rat, hmin) if feasible else (0.0, np.zeros(len(h)))
            parts.append(pd.DataFrame({
                "day": day, "rationality": rat, "num_of_hp": budget, "reward": reward,
                "used_hps": used, "feasible": feasible, "port": port, "prob": h,
                "multiplier": multiplier, "weight": weight,
            }))
        return pd.concat(parts, ignore_index=True)

    return solve_group


def strategy_sweep(top_ports: DataFrame, rationalities=None, honeypots=None,
                   rationality_step: float = 0.1, max_honeypots: float = 7.0,
                   honeypot_step: float = 1.0, partitions: int | None = None) -> DataFrame:
    """Best honeypot shares for each (day, rationality, budget) grid point.

    Each port row of a day is expanded over the rationality grid by a generator (no join);
    one pandas call per (day, rationality) solves the allocation for every budget of the
    grid (``operators.allocation``). A group holds one day's top ports only (<= 25 rows).

    The input is a few bytes per group but each group costs solver time, so the rows are
    hash-partitioned on the group keys into ``partitions`` (default: the cluster's default
    parallelism) explicitly; size-based coalescing would otherwise pack every group into
    one task. The grouped call reuses that partitioning (no second exchange).
    Output: day, rationality, num_of_hp, reward, used_hps, feasible, port, prob, and what
    proves the reward optimal: the budget's multiplier and a weight per port
    (:func:`sweep_certificate` checks them).
    """
    rats = rationalities if rationalities is not None else grid_values(1.0, rationality_step)
    hps = honeypots if honeypots is not None else grid_values(max_honeypots, honeypot_step)
    rat_values = ", ".join(f"{float(r)!r}D" for r in rats)
    rows = top_ports.select("day", F.col("port").cast("int").alias("port"), "attack_probability",
                            "open_port_probability", F.expr(f"explode(array({rat_values}))").alias("rationality"))
    keys = ["day", "rationality"]
    if partitions is None:
        from flowlure.session import default_parallelism

        partitions = default_parallelism(top_ports.sparkSession)
    solver = _group_solver(config.MIN_HONEYPOT_SHARE, hps)
    return rows.repartition(partitions, *keys).groupBy(*keys).applyInPandas(solver, SWEEP_SCHEMA)


def sweep_certificate(sweep: DataFrame, top_ports: DataFrame, hmin: float = config.MIN_HONEYPOT_SHARE,
                      gap: float = CERTIFIED_GAP) -> DataFrame:
    """Check every grid point of a sweep by weak duality, without solving anything.

    With weights w >= 0 of sum rat, ``rat * max(s/h) >= sum(w s/h)`` for every h; with a
    multiplier m >= 0 of the budget, no allowed h can then have a reward below
    ``sum_j min_h ((w s + (1 - rat) p s) / h + m h) - m * num_of_hp``, whose minima over
    [hmin, 1 - s] are closed forms. A point is ``certified`` when its shares keep all bounds and
    the budget, its weights are such weights, and the reward of its shares is within ``gap``
    (relative) of that bound. An infeasible point is not certified.
    Output: day, rationality, num_of_hp, ports, reward, bound, feasible, certified.
    """
    rows = sweep.join(top_ports.select("day", F.col("port").cast("int").alias("port"), F.col("attack_probability").alias("p"),
                                       F.col("open_port_probability").alias("s")), ["day", "port"])
    rat, m, h, s, up = F.col("rationality"), F.col("multiplier"), F.col("prob"), F.col("s"), F.lit(1.0) - F.col("s")
    priced = F.col("weight") * s + (F.lit(1.0) - rat) * F.col("p") * s
    free = F.when(m > 0, F.sqrt(priced / F.when(m > 0, m))).otherwise(F.when(priced > 0, up).otherwise(F.lit(hmin)))
    least = F.least(F.greatest(free, F.lit(hmin)), up)
    per_port = rows.select("day", "rationality", "num_of_hp", "feasible", "multiplier", "prob", "weight",
                           F.try_divide(s, h).alias("share"), F.try_divide(F.col("p") * s, h).alias("expected"),
                           F.try_divide(priced, least).alias("a"), (m * least).alias("b"),
                           ((h >= hmin * (1 - 1e-9)) & (h <= up + 1e-9) & (F.col("weight") >= 0)).alias("kept"))
    points = per_port.groupBy("day", "rationality", "num_of_hp").agg(
        F.count("*").alias("ports"), F.first("feasible").alias("feasible"),
        F.max("share").alias("share"), F.sum("expected").alias("expected"),
        (F.sum("a") + F.sum("b")).alias("priced"), F.first("multiplier").alias("m"),
        F.sum("prob").alias("used"), F.sum("weight").alias("weights"), F.bool_and("kept").alias("kept"))
    reward = F.when(F.col("feasible"), rat * F.col("share") + (F.lit(1.0) - rat) * F.col("expected")).otherwise(0.0)
    bound = F.when(F.col("feasible"), F.col("priced") - F.col("m") * F.col("num_of_hp"))
    scored = points.withColumn("reward", reward).withColumn("bound", bound)
    # Without an open port the maximum is 0 whatever the weights are.
    weighted = (F.abs(F.col("weights") - rat) <= 1e-9) | (F.col("share") == 0)
    proven = F.col("kept") & (F.col("m") >= 0) & (F.col("used") <= F.col("num_of_hp") + 1e-9) & weighted & (
        F.col("reward") - F.col("bound") <= gap * F.greatest(F.lit(1.0), F.col("reward")))
    return scored.select("day", "rationality", "num_of_hp", "ports", "reward", "bound", "feasible",
                         (F.col("feasible") & proven).alias("certified"))


def sweep_records(sweep: DataFrame) -> DataFrame:
    """Sweep output -> strategy records (``date`` = the statistics day) for ``write_strategies``."""
    from flowlure.sources.strategies import records_from_long

    return records_from_long(sweep.select(
        F.date_format("day", "yyyy-MM-dd").alias("date"), "rationality", "num_of_hp", "reward",
        "used_hps", "port", "prob"))
