"""Flow and strategy tables derived from the ``events`` test table.

The test data has no flow archive, so flows are derived row by row from ``events``; the
rules are fixed so the SQL oracle can derive the very same rows. Work grows with the
events table: one flow per event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the derivation (shared with the SQL oracle).
PORT_CHOICES = ("21", "22", "23", "25", "80", "443", "445", "3389", "8080", "3128", "2323", "na")
STATE_BY_EVENT_TYPE = {"error": "S_RA", "view": "S_", "click": "SR_SA", "signup": "FSPA_FSPA"}
STATE_OTHERWISE = "S_SA"

FIXTURE_PORTS = (21, 22, 80, 443, 445, 3389, 8080)
FIXTURE_HONEYPOTS = (1.0, 2.0)
FIXTURE_RATIONALITIES = (0.2, 0.8)

# A second derivation, over many ports: every limit of a report cuts, and no host share is near 1.
SCATTERED_FIRST_PORT = 20
SCATTERED_HOSTS = 250
SCATTERED_SOURCES = 120
SCATTERED_STRATEGY_PORTS = (20, 21, 22, 23, 24)
SCATTERED_HONEYPOTS = (1.0, 4.0)

EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _q(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def _flow_expressions() -> list[str]:
    ports = ", ".join(_q(p) for p in PORT_CHOICES)
    states = " ".join(f"WHEN event_type = {_q(k)} THEN {_q(v)}" for k, v in STATE_BY_EVENT_TYPE.items())
    return [
        "CASE WHEN event_id % 13 = 0 THEN 'udp' ELSE 'tcp' END AS Proto",
        "CASE WHEN user_id % 10 = 0 THEN concat('147.32.80.', CAST(user_id % 250 AS STRING))"
        " ELSE concat('10.0.', CAST(user_id % 7 AS STRING), '.', CAST(user_id % 250 AS STRING)) END AS SrcAddr",
        "CASE WHEN event_id % 11 = 0 THEN concat('192.168.0.', CAST(event_id % 20 AS STRING))"
        " WHEN event_id % 12 = 0 THEN concat('147.32.1.', CAST(event_id % 20 AS STRING))"
        " ELSE concat('147.32.8', CAST(event_id % 4 AS STRING), '.', CAST((event_id * 31) % 20 AS STRING)) END AS DstAddr",
        f"element_at(array({ports}), try_cast(regexp_extract(props, '(\\\\d+)', 1) AS INT) % 12 + 1) AS Dport",
        "CASE WHEN event_id % 17 = 0 THEN 'INT' WHEN event_id % 19 = 0 THEN 'S_SR' WHEN event_id % 23 = 0 THEN 'A_SPA_RA' "
        f"{states} ELSE {_q(STATE_OTHERWISE)} END AS State",
        "rpad(concat(replace(substr(CAST(ts AS STRING), 1, 10), '-', '/'), substr(CAST(ts AS STRING), 11, 9), '.',"
        " substr(CAST(ts AS STRING), 21)), 26, '0') AS StartTime",
    ]


def flows_from_events(events: DataFrame) -> DataFrame:
    """events(event_id, ts, user_id, event_type, props) -> raw flows (all STRING columns).

    One flow per event: protocol, addresses, port and state follow fixed arithmetic rules
    on the ids (shared with the SQL oracle); StartTime is the event time as archive text.
    """
    return events.selectExpr(*_flow_expressions())


def scattered_flows_from_events(events: DataFrame) -> DataFrame:
    """events -> raw flows over about 150 ports of falling popularity and 500 hosts, one flow per event.

    x = event_id * 7919 % 1000 gives the port ``20 + x * x div 6500``; two flows in five are
    answered, one in five was opened without the archive's answer flags, the rest is unused.
    """
    port = f"CAST({SCATTERED_FIRST_PORT} + (event_id * 7919 % 1000) * (event_id * 7919 % 1000) div 6500 AS STRING)"
    return events.selectExpr(
        "CASE WHEN event_id % 13 = 0 THEN 'udp' ELSE 'tcp' END AS Proto",
        f"concat('10.1.0.', CAST(user_id % {SCATTERED_SOURCES} AS STRING)) AS SrcAddr",
        f"concat('147.32.8', CAST(event_id % 4 AS STRING), '.', CAST((event_id * 31) % {SCATTERED_HOSTS} AS STRING)) AS DstAddr",
        f"CASE WHEN event_id % 29 = 0 THEN 'na' ELSE {port} END AS Dport",
        "CASE WHEN event_id % 17 = 0 THEN 'INT' WHEN event_id % 5 < 2 THEN 'SR_SA' WHEN event_id % 5 = 2 THEN 'S_SR' ELSE 'S_RA' END AS State",
        _flow_expressions()[-1],
    )


def scattered_strategy_records(flows: DataFrame) -> DataFrame:
    """Strategy records for every day of the scattered flows: budgets that hold and budgets that do not."""
    return _records(flows, SCATTERED_STRATEGY_PORTS, lambda p: 0.2 if p % 2 == 0 else 0.48, SCATTERED_HONEYPOTS)


def strategy_records_fixture(flows: DataFrame) -> DataFrame:
    """Strategy records (NDJSON shape) for every day present in prepared flows.

    One record per (day, rationality, num_of_hp) with ``date`` = day - 1 (a strategy applies
    the day after its date) and ``stg`` = [(port, prob)] with
    ``prob = (0.3 for even ports, 0.6 for odd) * num_of_hp / 2``. Built by projection only.
    """
    return _records(flows, FIXTURE_PORTS, lambda p: 0.3 if p % 2 == 0 else 0.6, FIXTURE_HONEYPOTS)


def _records(flows: DataFrame, ports, share, honeypots) -> DataFrame:
    setups = ", ".join(f"named_struct('rationality', {float(r)!r}D, 'num_of_hp', {float(h)!r}D)"
                       for r in FIXTURE_RATIONALITIES for h in honeypots)
    days = flows.where(F.col("day").isNotNull()).select("day").distinct()
    records = days.select(F.date_sub("day", 1).alias("d"), F.expr(f"inline(array({setups}))"))
    stg = F.expr("array(" + ", ".join(
        f"named_struct('port', {p}, 'prob', {share(p)!r}D * num_of_hp / 2.0D)" for p in ports) + ")")
    return records.select(
        F.col("d").cast("string").alias("date"),
        "rationality", "num_of_hp",
        F.lit(None).cast("double").alias("reward"),
        F.aggregate(stg, F.lit(0.0), lambda acc, x: acc + x["prob"]).alias("used_hps"),
        stg.alias("stg"),
    )
