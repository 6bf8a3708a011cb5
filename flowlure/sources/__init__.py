"""Readers and writers."""

from flowlure.sources.events import (
    flows_from_events,
    scattered_flows_from_events,
    scattered_strategy_records,
    strategy_records_fixture,
)
from flowlure.sources.flows import RAW_FLOW_SCHEMA, read_flow_archive, read_flows_of_days
from flowlure.sources.statistics import (
    read_daily_statistics,
    read_statistics_document,
    read_statistics_lines,
    write_daily_statistics,
    write_statistics_lines,
)
from flowlure.sources.strategies import read_strategies, write_strategies
from flowlure.sources.results import write_csv, write_parquet

__all__ = [
    "RAW_FLOW_SCHEMA", "flows_from_events", "read_daily_statistics", "read_flow_archive",
    "read_flows_of_days", "read_statistics_document", "read_statistics_lines", "read_strategies",
    "scattered_flows_from_events", "scattered_strategy_records", "strategy_records_fixture", "write_csv", "write_daily_statistics", "write_parquet",
    "write_statistics_lines", "write_strategies",
]
