"""Plain-SQL statements of the registered queries (DuckDB dialect, ``events`` as a view).

Written independently of the DataFrame code, row for row the same semantics; used by the
correctness check to compare values. Shared pieces are CTE fragments.
"""

from __future__ import annotations

from flowlure import config
from flowlure.operators.game import grid_values
from flowlure.plans.catalog import HIT_SUMMARY_SETUP, PAIR_SAMPLE_RATE, REWARD_ROUND, ROUND
from flowlure.plans.files import EVALUATED_EVERY
from flowlure.sources.events import (
    FIXTURE_HONEYPOTS,
    FIXTURE_PORTS,
    FIXTURE_RATIONALITIES,
    PORT_CHOICES,
    SCATTERED_FIRST_PORT,
    SCATTERED_HONEYPOTS,
    SCATTERED_HOSTS,
    SCATTERED_SOURCES,
    SCATTERED_STRATEGY_PORTS,
    STATE_BY_EVENT_TYPE,
    STATE_OTHERWISE,
)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _roll(*parts: str) -> str:
    return ("CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8) AS BIGINT)"
            " / 4294967296.0::DOUBLE")


def _flow_roll(tag: str) -> str:
    return _roll("SrcAddr", "DstAddr", "CAST(Dport AS VARCHAR)", "strftime(ts, '%Y%m%d%H%M%S%f')", _q(tag))


_PORTS = ", ".join(_q(p) for p in PORT_CHOICES)
_STATE_CASES = " ".join(f"WHEN event_type = {_q(k)} THEN {_q(v)}" for k, v in STATE_BY_EVENT_TYPE.items())

RAW = f"""raw_flows AS (
  SELECT
    CASE WHEN event_id % 13 = 0 THEN 'udp' ELSE 'tcp' END AS Proto,
    CASE WHEN user_id % 10 = 0 THEN '147.32.80.' || CAST(user_id % 250 AS VARCHAR)
         ELSE '10.0.' || CAST(user_id % 7 AS VARCHAR) || '.' || CAST(user_id % 250 AS VARCHAR) END AS SrcAddr,
    CASE WHEN event_id % 11 = 0 THEN '192.168.0.' || CAST(event_id % 20 AS VARCHAR)
         WHEN event_id % 12 = 0 THEN '147.32.1.' || CAST(event_id % 20 AS VARCHAR)
         ELSE '147.32.8' || CAST(event_id % 4 AS VARCHAR) || '.' || CAST((event_id * 31) % 20 AS VARCHAR) END AS DstAddr,
    ([{_PORTS}])[TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) % 12 + 1] AS Dport,
    CASE WHEN event_id % 17 = 0 THEN 'INT' WHEN event_id % 19 = 0 THEN 'S_SR' WHEN event_id % 23 = 0 THEN 'A_SPA_RA'
         {_STATE_CASES} ELSE {_q(STATE_OTHERWISE)} END AS State,
    strftime(ts, '%Y/%m/%d %H:%M:%S.%f') AS StartTime
  FROM events)"""


RAW_SCATTERED = f"""raw_flows AS (
  SELECT
    CASE WHEN event_id % 13 = 0 THEN 'udp' ELSE 'tcp' END AS Proto,
    '10.1.0.' || CAST(user_id % {SCATTERED_SOURCES} AS VARCHAR) AS SrcAddr,
    '147.32.8' || CAST(event_id % 4 AS VARCHAR) || '.' || CAST((event_id * 31) % {SCATTERED_HOSTS} AS VARCHAR) AS DstAddr,
    CASE WHEN event_id % 29 = 0 THEN 'na'
         ELSE CAST({SCATTERED_FIRST_PORT} + ((event_id * 7919 % 1000) * (event_id * 7919 % 1000)) // 6500 AS VARCHAR) END AS Dport,
    CASE WHEN event_id % 17 = 0 THEN 'INT' WHEN event_id % 5 < 2 THEN 'SR_SA' WHEN event_id % 5 = 2 THEN 'S_SR' ELSE 'S_RA' END AS State,
    strftime(ts, '%Y/%m/%d %H:%M:%S.%f') AS StartTime
  FROM events)"""


def flows_cte(name: str, prefix: str, drop_null_port: bool, source: str = "raw_flows") -> str:
    null_filter = " AND TRY_CAST(Dport AS INTEGER) IS NOT NULL" if drop_null_port else ""
    return f"""{name} AS (
  SELECT SrcAddr, DstAddr, TRY_CAST(Dport AS INTEGER) AS Dport, State,
         try_strptime(StartTime, '%Y/%m/%d %H:%M:%S.%f') AS ts,
         CAST(try_strptime(substr(StartTime, 1, 10), '%Y/%m/%d') AS DATE) AS "day",
         regexp_matches(State, {_q(config.UNUSED_PORT_PATTERN)}) AS unused,
         regexp_matches(State, {_q(config.ANSWERED_PATTERN)}) AS answered
  FROM {source}
  WHERE Proto = 'tcp' AND starts_with(DstAddr, {_q(prefix)}) AND NOT starts_with(SrcAddr, {_q(prefix)}){null_filter})"""


def attackers_cte(name: str, flows: str) -> str:
    return f"""{name} AS (
  SELECT SrcAddr, "day", count(DISTINCT DstAddr) AS addr_count, count(DISTINCT Dport) AS port_count
  FROM {flows} GROUP BY SrcAddr, "day"
  HAVING count(DISTINCT DstAddr) >= {config.MIN_ATTACKED_HOSTS} OR count(DISTINCT Dport) >= {config.MIN_ATTACKED_PORTS})"""


def attacker_flows_cte(name: str, flows: str, attackers: str) -> str:
    return f"""{name} AS (
  SELECT f.* FROM {flows} f
  WHERE EXISTS (SELECT 1 FROM {attackers} a WHERE a.SrcAddr = f.SrcAddr AND a."day" = f."day"))"""


WIDE = ",\n".join([RAW, flows_cte("flows_wide", config.NETWORK_PREFIX_WIDE, False),
                   attackers_cte("attackers_wide", "flows_wide"),
                   attacker_flows_cte("attf_wide", "flows_wide", "attackers_wide")])
EVAL = ",\n".join([RAW, flows_cte("flows_eval", config.NETWORK_PREFIX_EVAL, True),
                   flows_cte("flows_eval_all", config.NETWORK_PREFIX_EVAL, False),
                   attackers_cte("attackers_eval", "flows_eval"),
                   attacker_flows_cte("attf_eval", "flows_eval", "attackers_eval")])


def _values(rows, names: str, types) -> str:
    body = ", ".join("(" + ", ".join(f"CAST({v!r} AS {t})" for v, t in zip(row, types)) + ")" for row in rows)
    return f"(VALUES {body}) AS {names}"


STRATEGIES = f"""strat_days AS (SELECT DISTINCT "day" FROM flows_eval_all WHERE "day" IS NOT NULL),
strategies AS (
  SELECT strftime(d."day" - 1, '%Y-%m-%d') || '_' || CAST(h.num_of_hp AS VARCHAR) || '_' || CAST(r.rationality AS VARCHAR) AS strategy_id,
         d."day" AS application_date, r.rationality, h.num_of_hp, p.port,
         CASE WHEN p.port % 2 = 0 THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END * h.num_of_hp / 2.0::DOUBLE AS prob
  FROM strat_days d,
       {_values([(r,) for r in FIXTURE_RATIONALITIES], 'r(rationality)', ['DOUBLE'])},
       {_values([(h,) for h in FIXTURE_HONEYPOTS], 'h(num_of_hp)', ['DOUBLE'])},
       {_values([(p,) for p in FIXTURE_PORTS], 'p(port)', ['INTEGER'])})"""

ATTACK_WIDE = """ap_totals AS (SELECT "day", count(*) AS total_attackers FROM attackers_wide GROUP BY "day"),
ap_per_port AS (SELECT "day", Dport, count(DISTINCT SrcAddr) AS attackers FROM attf_wide GROUP BY "day", Dport),
attack_prob AS (
  SELECT p."day", p.Dport, p.attackers, t.total_attackers,
         CAST(p.attackers AS DOUBLE) / t.total_attackers AS attack_probability
  FROM ap_per_port p JOIN ap_totals t ON p."day" = t."day"
  WHERE CAST(p.attackers AS DOUBLE) / t.total_attackers > 0)"""

OPEN_WIDE = """op_open AS (SELECT * FROM flows_wide WHERE Dport IS NOT NULL AND NOT unused),
op_active AS (SELECT "day", count(DISTINCT DstAddr) AS active_hosts FROM op_open GROUP BY "day"),
op_per_port AS (SELECT "day", Dport, count(DISTINCT DstAddr) AS host_count FROM op_open GROUP BY "day", Dport),
open_prob AS (
  SELECT p."day", p.Dport, p.host_count, a.active_hosts, CAST(p.host_count AS DOUBLE) / a.active_hosts AS ratio
  FROM op_per_port p JOIN op_active a ON p."day" = a."day"
  WHERE CAST(p.host_count AS DOUBLE) / a.active_hosts > 0)"""

PRODUCTION_WIDE = """pr_prod AS (SELECT * FROM flows_wide WHERE answered),
pr_totals AS (SELECT "day", count(DISTINCT DstAddr) AS total_hosts FROM pr_prod GROUP BY "day"),
pr_per_port AS (SELECT "day", Dport, count(DISTINCT DstAddr) AS host_count FROM pr_prod GROUP BY "day", Dport),
production AS (
  SELECT p."day", p.Dport, p.host_count, t.total_hosts, CAST(p.host_count AS DOUBLE) / t.total_hosts AS ratio
  FROM pr_per_port p JOIN pr_totals t ON p."day" = t."day")"""

STATS = ATTACK_WIDE + ",\n" + OPEN_WIDE + """,
stats AS (
  SELECT coalesce(a."day", o."day") AS "day", coalesce(a.port, o.port) AS port,
         coalesce(a.attack_probability, 0.0::DOUBLE) AS attack_probability,
         coalesce(o.open_port_probability, 0.0::DOUBLE) AS open_port_probability
  FROM (SELECT "day", Dport AS port, attack_probability FROM attack_prob WHERE Dport IS NOT NULL) a
  FULL OUTER JOIN (SELECT "day", Dport AS port, ratio AS open_port_probability FROM open_prob) o
    ON a."day" = o."day" AND a.port = o.port)"""


def status_share_cte(name: str, att: str) -> str:
    return f"""{name}_st AS (SELECT DISTINCT DstAddr, Dport, "day", NOT answered AS candidate FROM {att}),
{name}_c AS (SELECT "day", Dport, candidate, count(*) AS host_count FROM {name}_st GROUP BY "day", Dport, candidate),
{name} AS (
  SELECT "day", Dport, candidate, host_count,
         CAST(sum(host_count) OVER (PARTITION BY "day", Dport) AS BIGINT) AS total,
         CAST(host_count AS DOUBLE) / CAST(sum(host_count) OVER (PARTITION BY "day", Dport) AS BIGINT) AS share
  FROM {name}_c)"""


UNUSED_EVAL = """uh_totals AS (SELECT "day", count(DISTINCT DstAddr) AS total_hosts FROM attf_eval GROUP BY "day"),
uh_unused AS (SELECT "day", Dport, count(DISTINCT DstAddr) AS unused_hosts FROM attf_eval WHERE unused GROUP BY "day", Dport),
unused_hosts AS (
  SELECT u."day", u.Dport, u.unused_hosts, t.total_hosts, CAST(u.unused_hosts + 1 AS DOUBLE) / t.total_hosts AS ratio
  FROM uh_unused u JOIN uh_totals t ON u."day" = t."day")"""

CANDIDATES = f"""cand AS (SELECT SrcAddr, DstAddr, Dport, ts, "day", {_flow_roll(config.ROLL_SEED)} AS roll
  FROM attf_eval WHERE unused)"""

ASSIGN_PROB = CANDIDATES + """,
assign AS (
  SELECT c.SrcAddr, c.DstAddr, c.Dport, c.ts, c."day", s.strategy_id, s.prob, c.roll, c.roll <= s.prob AS is_hp
  FROM cand c JOIN strategies s ON c."day" = s.application_date AND c.Dport = s.port)"""

DETECT = """det AS (SELECT SrcAddr, strategy_id, "day", min(ts) AS detection_time FROM assign WHERE is_hp
  GROUP BY SrcAddr, strategy_id, "day")"""

SAVED = """sv_open AS (SELECT SrcAddr, "day", ts FROM attf_eval WHERE NOT unused),
sv_totals AS (SELECT "day", count(*) AS total_attacks FROM sv_open GROUP BY "day"),
sv_saved AS (
  SELECT d.strategy_id, o."day", count(*) AS saved
  FROM sv_open o JOIN det d ON o.SrcAddr = d.SrcAddr AND o."day" = d."day"
  WHERE o.ts > d.detection_time GROUP BY d.strategy_id, o."day"),
saved AS (
  SELECT s.strategy_id, s."day", s.saved, t.total_attacks, CAST(s.saved AS DOUBLE) / t.total_attacks AS saved_ratio
  FROM sv_saved s JOIN sv_totals t ON s."day" = t."day")"""


def _map_values(mapping: dict, name: str) -> str:
    rows = sorted((int(p), float(v)) for p, v in mapping.items())
    return f"{name} AS (SELECT * FROM {_values(rows, name + '_v(port, prob)', ['INTEGER', 'DOUBLE'])})"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _grid_sql() -> str:
    rats = grid_values(1.0, 0.1)
    hps = grid_values(7.0, 1.0)
    return (_values([(r,) for r in rats], "gr(rationality)", ["DOUBLE"]) + ", "
            + _values([(h,) for h in hps], "gh(num_of_hp)", ["DOUBLE"]))


def build() -> dict[str, str]:
    R = ROUND
    q: dict[str, str] = {}
    q["prepared_flows"] = _with(EVAL) + "SELECT SrcAddr, DstAddr, Dport, State, ts, \"day\", unused, answered FROM flows_eval_all"
    q["daily_attackers"] = _with(EVAL) + "SELECT SrcAddr, \"day\", addr_count, port_count FROM attackers_eval"
    q["attacker_flows"] = _with(EVAL) + "SELECT SrcAddr, \"day\", DstAddr, Dport, State, ts, unused, answered FROM attf_eval"
    q["attack_probability_daily"] = _with(WIDE, ATTACK_WIDE) + "SELECT * FROM attack_prob"
    q["average_attackers_per_port"] = _with(WIDE, ATTACK_WIDE) + """SELECT Dport, avg(attackers) AS average_count
FROM ap_per_port GROUP BY Dport ORDER BY average_count DESC, Dport ASC NULLS LAST LIMIT 100"""
    q["open_port_probability_daily"] = _with(WIDE, OPEN_WIDE) + "SELECT * FROM open_prob"
    q["production_ratio_daily"] = _with(WIDE, PRODUCTION_WIDE) + "SELECT * FROM production"
    q["average_production_ratio"] = _with(WIDE, PRODUCTION_WIDE) + f"""SELECT Dport, round(average_ratio, {R}) AS average_ratio
FROM (SELECT Dport, avg(ratio) AS average_ratio FROM production GROUP BY Dport
      ORDER BY average_ratio DESC, Dport ASC NULLS LAST LIMIT 100)"""
    q["daily_port_statistics"] = _with(WIDE, STATS) + "SELECT * FROM stats"
    q["daily_statistics_document"] = _with(WIDE, STATS) + """SELECT "day", CAST(count(*) AS INTEGER) AS ports,
  CAST(to_json(map_from_entries(list({'k': CAST(port AS VARCHAR), 'v': attack_probability} ORDER BY CAST(port AS VARCHAR)))) AS VARCHAR) AS attacker_strategy,
  CAST(to_json(map_from_entries(list({'k': CAST(port AS VARCHAR), 'v': open_port_probability} ORDER BY CAST(port AS VARCHAR)))) AS VARCHAR) AS production_distribution
FROM stats WHERE port IS NOT NULL GROUP BY "day\""""
    q["strategy_long"] = _with(EVAL, STRATEGIES) + "SELECT * FROM strategies"
    q["unused_hosts_per_port"] = _with(EVAL, UNUSED_EVAL) + "SELECT * FROM unused_hosts"
    q["port_status_share"] = _with(WIDE, status_share_cte("pss", "attf_wide")) + "SELECT * FROM pss"
    q["honeypot_assignment"] = _with(EVAL, STRATEGIES, ASSIGN_PROB) + "SELECT * FROM assign"
    q["first_detection"] = _with(EVAL, STRATEGIES, ASSIGN_PROB, DETECT) + "SELECT * FROM det"
    q["saved_flows"] = _with(EVAL, STRATEGIES, ASSIGN_PROB, DETECT, SAVED) + "SELECT * FROM saved"
    q["strategy_setup_summary"] = _with(EVAL, STRATEGIES, ASSIGN_PROB, DETECT, SAVED) + f"""SELECT st.rationality, st.num_of_hp,
  round(avg(s.saved_ratio), {R}) AS avg_saved_ratio, round(stddev_samp(s.saved_ratio), {R}) AS stddev
FROM saved s JOIN (SELECT DISTINCT strategy_id, rationality, num_of_hp FROM strategies) st ON s.strategy_id = st.strategy_id
GROUP BY st.rationality, st.num_of_hp"""
    rat, hp = HIT_SUMMARY_SETUP
    q["port_hit_summary"] = _with(EVAL, STRATEGIES, UNUSED_EVAL, CANDIDATES, f"""strat_sel AS (
  SELECT * FROM strategies WHERE round(rationality, 6) = {rat!r} AND round(num_of_hp, 6) = {hp!r}),
assign AS (
  SELECT c.SrcAddr, c.Dport, c.ts, c."day", s.strategy_id,
         (u.ratio <= s.prob) OR (c.roll < s.prob / u.ratio) AS is_hp
  FROM cand c JOIN unused_hosts u ON c."day" = u."day" AND c.Dport = u.Dport
  JOIN strat_sel s ON c."day" = s.application_date AND c.Dport = s.port)""", DETECT, """hits AS (
  SELECT a.Dport, a."day" FROM assign a
  WHERE a.is_hp AND EXISTS (SELECT 1 FROM det d WHERE d.SrcAddr = a.SrcAddr AND d.strategy_id = a.strategy_id
                            AND d."day" = a."day" AND d.detection_time = a.ts)),
per_day AS (SELECT Dport, "day", count(*) AS hit FROM hits GROUP BY Dport, "day")""") + f"""SELECT Dport,
  round(avg(hit), {R}) AS avg_hit, round(stddev_samp(hit), {R}) AS stddev
FROM per_day GROUP BY Dport"""
    q["fixed_strategy_daily_results"] = _with(WIDE, status_share_cte("pss", "attf_wide"),
                                              _map_values(config.MIXED_STRATEGY, "fixed_map"), f"""base AS (
  SELECT DISTINCT DstAddr, Dport, State, ts, NOT answered AS candidate, "day", SrcAddr FROM attf_wide),
hp_rows AS (
  SELECT DISTINCT b.DstAddr, b.Dport, b.ts, b."day", b.SrcAddr
  FROM base b JOIN fixed_map m ON b.Dport = m.port
  JOIN (SELECT "day", Dport, share AS ratio FROM pss WHERE candidate) s ON s."day" = b."day" AND s.Dport = b.Dport
  WHERE b.candidate AND ((s.ratio <= m.prob) OR ({_roll('b.SrcAddr', 'b.DstAddr', 'CAST(b.Dport AS VARCHAR)', "strftime(b.ts, '%Y%m%d%H%M%S%f')", _q('mixed'))} < m.prob / s.ratio))),
firsts AS (SELECT SrcAddr, min(ts) AS ts FROM hp_rows GROUP BY SrcAddr),
first_hits AS (SELECT h.* FROM hp_rows h WHERE EXISTS (SELECT 1 FROM firsts f WHERE f.SrcAddr = h.SrcAddr AND f.ts = h.ts)),
open_rows AS (SELECT SrcAddr, "day", ts AS open_ts FROM base WHERE NOT candidate),
fs_saved AS (
  SELECT h."day", count(*) AS saved_count FROM first_hits h
  JOIN open_rows o ON h.SrcAddr = o.SrcAddr AND h."day" = o."day" WHERE h.ts < o.open_ts GROUP BY h."day"),
hp_counts AS (SELECT "day", count(*) AS hp_count FROM first_hits GROUP BY "day")""") + """SELECT s."day", s.saved_count, c.hp_count
FROM fs_saved s JOIN hp_counts c ON s."day" = c."day\""""
    sample = f"{_roll('SrcAddr', _q(str(config.SAMPLE_SEED)))} < {PAIR_SAMPLE_RATE!r}"
    q["source_sample"] = _with(EVAL) + f"SELECT DISTINCT SrcAddr FROM flows_eval_all WHERE {sample}"
    q["strategy_pair_comparison"] = _with(
        EVAL, f"sampled AS (SELECT * FROM flows_eval_all WHERE {sample})",
        attackers_cte("att_s", "sampled"), attacker_flows_cte("attf_s", "sampled", "att_s"),
        _map_values(config.MIXED_STRATEGY, "map_a"), _map_values(config.ALWAYS_ON_STRATEGY, "map_b"),
        f"""pc_unused AS (SELECT "day", Dport, count(DISTINCT DstAddr) AS unused_hosts FROM attf_s WHERE unused GROUP BY "day", Dport),
pc_hosts AS (SELECT "day", count(DISTINCT DstAddr) AS total_hosts FROM attf_s GROUP BY "day"),
scored AS (
  SELECT f.SrcAddr, f."day", f.ts, f.unused, ma.prob AS prob_a, mb.prob AS prob_b,
         CAST(u.unused_hosts + 1 AS DOUBLE) / h.total_hosts AS ratio,
         {_roll('f.SrcAddr', 'f.DstAddr', 'CAST(f.Dport AS VARCHAR)', "strftime(f.ts, '%Y%m%d%H%M%S%f')", _q('mixed'))} AS roll_a,
         {_roll('f.SrcAddr', 'f.DstAddr', 'CAST(f.Dport AS VARCHAR)', "strftime(f.ts, '%Y%m%d%H%M%S%f')", _q('always_on'))} AS roll_b
  FROM attf_s f LEFT JOIN pc_unused u ON f."day" = u."day" AND f.Dport = u.Dport
  JOIN pc_hosts h ON f."day" = h."day"
  LEFT JOIN map_a ma ON f.Dport = ma.port LEFT JOIN map_b mb ON f.Dport = mb.port),
pc_det AS (
  SELECT SrcAddr, "day",
    min(CASE WHEN prob_a IS NOT NULL AND ((ratio <= prob_a) OR (roll_a < prob_a / ratio)) AND unused THEN ts END) AS det_a,
    min(CASE WHEN prob_b IS NOT NULL AND ((ratio <= prob_b) OR (roll_b < prob_b / ratio)) AND unused THEN ts END) AS det_b
  FROM scored GROUP BY SrcAddr, "day")""") + """SELECT a."day", count(*) FILTER (WHERE o.ts > d.det_a) AS saved_a, count(*) FILTER (WHERE o.ts > d.det_b) AS saved_b
FROM (SELECT DISTINCT "day" FROM flows_eval_all WHERE "day" IS NOT NULL) a
LEFT JOIN (SELECT SrcAddr, "day", ts FROM attf_s WHERE NOT unused) o ON o."day" = a."day"
LEFT JOIN pc_det d ON o.SrcAddr = d.SrcAddr AND o."day" = d."day"
GROUP BY a."day\""""
    q["top_attacked_ports"] = _with(WIDE, STATS) + f"""SELECT * FROM (
  SELECT "day", port, attack_probability, open_port_probability,
         CAST(row_number() OVER (PARTITION BY "day" ORDER BY attack_probability DESC, port ASC) AS INTEGER) AS rank
  FROM stats WHERE port IS NOT NULL) WHERE rank <= {config.TOP_PORTS}"""
    q["strategy_parameter_grid"] = _with(WIDE, STATS) + f"""SELECT d."day", gr.rationality, gh.num_of_hp
FROM (SELECT DISTINCT "day" FROM stats) d, {_grid_sql()}"""
    q["strategy_scoring"] = _with(WIDE, STATS, EVAL.replace(RAW + ",\n", ""), STRATEGIES, """sc_rows AS (
  SELECT strategy_id, application_date - 1 AS "day", rationality, num_of_hp, port, prob AS h FROM strategies),
sc_joined AS (
  SELECT r.strategy_id, r."day", r.rationality, r.num_of_hp, r.h,
         coalesce(s.attack_probability, 0.0::DOUBLE) AS p, coalesce(s.open_port_probability, 0.0::DOUBLE) AS s
  FROM sc_rows r LEFT JOIN stats s ON r."day" = s."day" AND r.port = s.port)""") + f"""SELECT strategy_id, "day", rationality, num_of_hp,
  count(*) AS ports,
  round(rationality * max(s / h) + (1.0::DOUBLE - rationality) * sum(p * s / h), {R}) AS reward,
  round(sum(h), {R}) AS used_hps,
  (min(h) >= {config.MIN_HONEYPOT_SHARE!r} AND max(h + s) <= 1.0::DOUBLE + 1e-9 AND sum(h) <= num_of_hp + 1e-9) AS feasible
FROM sc_joined GROUP BY strategy_id, "day", rationality, num_of_hp"""
    scattered = WIDE.replace(RAW, RAW_SCATTERED)
    top = f"""top AS (SELECT * FROM (
  SELECT "day", port, attack_probability, open_port_probability,
         CAST(row_number() OVER (PARTITION BY "day" ORDER BY attack_probability DESC, port ASC) AS INTEGER) AS rank
  FROM stats WHERE port IS NOT NULL) WHERE rank <= {config.TOP_PORTS})"""
    q["scattered_top_ports"] = _with(scattered, STATS, top) + "SELECT * FROM top"
    q["scattered_average_attackers"] = _with(scattered, ATTACK_WIDE) + f"""SELECT Dport, round(avg(attackers), {R}) AS average_count
FROM ap_per_port GROUP BY Dport ORDER BY avg(attackers) DESC, Dport ASC NULLS LAST LIMIT 100"""
    q["scattered_average_production"] = _with(scattered, PRODUCTION_WIDE) + f"""SELECT Dport, round(average_ratio, {R}) AS average_ratio
FROM (SELECT Dport, avg(ratio) AS average_ratio FROM production GROUP BY Dport
      ORDER BY average_ratio DESC, Dport ASC NULLS LAST LIMIT 100)"""
    q["scattered_scoring"] = _with(scattered, STATS, f"""st_days AS (SELECT DISTINCT "day" FROM flows_wide WHERE "day" IS NOT NULL),
sc_rows AS (
  SELECT strftime(d."day" - 1, '%Y-%m-%d') || '_' || CAST(h.num_of_hp AS VARCHAR) || '_' || CAST(r.rationality AS VARCHAR) AS strategy_id,
         d."day", r.rationality, h.num_of_hp, p.port, CASE WHEN p.port % 2 = 0 THEN 0.2::DOUBLE ELSE 0.48::DOUBLE END * h.num_of_hp / 2.0::DOUBLE AS h
  FROM st_days d, {_values([(x,) for x in FIXTURE_RATIONALITIES], 'r(rationality)', ['DOUBLE'])},
       {_values([(x,) for x in SCATTERED_HONEYPOTS], 'h(num_of_hp)', ['DOUBLE'])},
       {_values([(x,) for x in SCATTERED_STRATEGY_PORTS], 'p(port)', ['INTEGER'])}),
sc_joined AS (
  SELECT r.strategy_id, r."day", r.rationality, r.num_of_hp, r.h,
         coalesce(s.attack_probability, 0.0::DOUBLE) AS p, coalesce(s.open_port_probability, 0.0::DOUBLE) AS s
  FROM sc_rows r LEFT JOIN stats s ON r."day" = s."day" AND r.port = s.port)""") + f"""SELECT strategy_id, "day", rationality, num_of_hp,
  count(*) AS ports,
  round(rationality * max(s / h) + (1.0::DOUBLE - rationality) * sum(p * s / h), {R}) AS reward,
  round(sum(h), {R}) AS used_hps,
  (min(h) >= {config.MIN_HONEYPOT_SHARE!r} AND max(h + s) <= 1.0::DOUBLE + 1e-9 AND sum(h) <= num_of_hp + 1e-9) AS feasible
FROM sc_joined GROUP BY strategy_id, "day", rationality, num_of_hp"""
    # Both edges of the game in closed form: how far the shares can rise before the budget is used
    # is a sum of straight pieces, whose corners are where a port starts or stops to rise.
    hmin = repr(config.MIN_HONEYPOT_SHARE)
    pieces = """{0}_corners AS (SELECT "day", x, sum(d) AS d FROM ({1}) GROUP BY "day", x),
{0}_slopes AS (SELECT "day", x, sum(d) OVER w AS slope, lead(x) OVER w AS x2 FROM {0}_corners
  WINDOW w AS (PARTITION BY "day" ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{0}_sums AS (SELECT s."day", s.x, s.slope, n.ports * {2} + coalesce(sum(s.slope * (s.x2 - s.x)) OVER (
    PARTITION BY s."day" ORDER BY s.x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS used
  FROM {0}_slopes s JOIN ports n ON n."day" = s."day"),
{0}_at AS (SELECT "day", num_of_hp, max_by(x + CASE WHEN slope > 0 THEN (num_of_hp - used) / slope ELSE 0 END, x) AS x
  FROM {0}_sums JOIN gh ON used <= num_of_hp GROUP BY "day", num_of_hp)"""
    q["strategy_sweep_certified"] = _with(scattered, STATS, top, "gh AS (SELECT * FROM " + _values([(x,) for x in grid_values(7.0, 1.0)], "g(num_of_hp)", ["DOUBLE"]) + ")",
        "gr AS (SELECT * FROM " + _values([(x,) for x in grid_values(1.0, 0.1)], "g(rationality)", ["DOUBLE"]) + ")", f"""
game AS (SELECT "day", attack_probability AS p, open_port_probability AS s, sqrt(attack_probability * open_port_probability) AS r FROM top),
ports AS (SELECT "day", count(*) AS ports, max(s) AS most, sum(CASE WHEN r > 0 THEN 1 - s ELSE {hmin} END) AS room,
    min(CASE WHEN s > 0 THEN (1 - s) / s END) AS cap FROM game GROUP BY "day")""",
        pieces.format("even", f'SELECT "day", {hmin} / r AS x, r AS d FROM game WHERE r > 0 UNION ALL SELECT "day", (1 - s) / r, -r FROM game WHERE r > 0', hmin),
        pieces.format("worst", f'SELECT "day", {hmin} / s AS x, s AS d FROM game WHERE s > 0', hmin),
        f"""even AS (SELECT g."day", h.num_of_hp, sum(g.p * g.s / CASE WHEN n.room <= h.num_of_hp THEN 1 - g.s
      ELSE greatest({hmin}, least(1 - g.s, e.x * g.r)) END) AS reward
  FROM game g JOIN ports n ON n."day" = g."day" CROSS JOIN gh h LEFT JOIN even_at e ON e."day" = g."day" AND e.num_of_hp = h.num_of_hp
  WHERE g.r > 0 GROUP BY g."day", h.num_of_hp),
worst AS (SELECT w."day", w.num_of_hp, 1 / least(n.cap, w.x) AS reward FROM worst_at w JOIN ports n ON n."day" = w."day")""") + f"""SELECT n."day", r.rationality, h.num_of_hp, n.ports,
  (h.num_of_hp >= n.ports * {hmin} * (1 - 1e-12) AND 1 - n.most >= {hmin}) AS feasible,
  (h.num_of_hp >= n.ports * {hmin} * (1 - 1e-12) AND 1 - n.most >= {hmin}) AS certified,
  round(CASE WHEN h.num_of_hp >= n.ports * {hmin} * (1 - 1e-12) AND 1 - n.most >= {hmin} THEN
    CASE WHEN r.rationality = 0 THEN coalesce(e.reward, 0) WHEN r.rationality = 1 THEN coalesce(w.reward, 0) END END, {REWARD_ROUND}) AS edge_reward
FROM ports n CROSS JOIN gh h CROSS JOIN gr r
LEFT JOIN even e ON e."day" = n."day" AND e.num_of_hp = h.num_of_hp
LEFT JOIN worst w ON w."day" = n."day" AND w.num_of_hp = h.num_of_hp"""
    chosen = f'("day" IN (SELECT application_date FROM strategies WHERE day(application_date) % {EVALUATED_EVERY} = 0))'
    q["archive_days"] = _with(EVAL) + """SELECT SrcAddr, DstAddr, Dport, State, ts, "day", unused, answered FROM flows_eval_all
WHERE "day" BETWEEN DATE '2024-01-10' AND DATE '2024-01-19'"""
    q["archive_strategy_days"] = _with(EVAL, STRATEGIES) + f'SELECT SrcAddr, "day", DstAddr, Dport, State, ts, unused, answered FROM attf_eval WHERE {chosen}'
    repeated = RAW.replace("FROM events)", """FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 0
    UNION ALL SELECT * FROM events WHERE event_id % 9 = 0))""")
    q["deduplicated_flows"] = _with(repeated, "one_each AS (SELECT DISTINCT * FROM raw_flows)", flows_cte("kept", config.NETWORK_PREFIX_EVAL, False, "one_each")) + (
        'SELECT SrcAddr, DstAddr, Dport, State, ts, "day", unused, answered FROM kept')
    q["strategies_file"] = q["strategies_documents"] = q["strategy_long"]
    q["statistics_records"] = q["daily_port_statistics"]
    q["statistics_lines"] = _with(WIDE, STATS) + "SELECT *, TRUE AS stamped FROM stats WHERE port IS NOT NULL"
    q["statistics_documents"] = _with(WIDE, STATS) + "SELECT * FROM stats WHERE port IS NOT NULL"
    q["parquet_results"] = q["attack_probability_daily"]
    q["csv_results"] = q["open_port_probability_daily"]
    return q


ORACLE_SQL = build()
