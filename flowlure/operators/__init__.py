"""DataFrame -> DataFrame operators. No operator reads paths, sets session state or runs actions."""

from flowlure.operators.fixed import fixed_strategy_daily_results, strategy_pair_comparison
from flowlure.operators.flows import (
    attacker_flows,
    daily_attackers,
    drop_repeated_rows,
    prepare_flows,
    sample_sources,
    source_sample,
)
from flowlure.operators.game import (
    strategy_parameter_grid,
    strategy_scoring,
    strategy_sweep,
    sweep_certificate,
    sweep_records,
    top_attacked_ports,
)
from flowlure.operators.ports import (
    attack_probability_daily,
    average_attackers_per_port,
    average_production_ratio,
    daily_port_statistics,
    daily_statistics_document,
    open_port_probability_daily,
    port_status_share,
    production_ratio_daily,
    unused_hosts_per_port,
)
from flowlure.operators.replay import (
    detections,
    first_detection,
    honeypot_assignment,
    port_hit_summary,
    record_low_flows,
    saved_flows,
    strategies_by_port,
    strategy_long,
    strategy_setup_summary,
)

__all__ = [
    "attack_probability_daily", "attacker_flows", "average_attackers_per_port",
    "average_production_ratio", "daily_attackers", "daily_port_statistics",
    "daily_statistics_document", "detections", "drop_repeated_rows", "first_detection", "fixed_strategy_daily_results",
    "honeypot_assignment", "open_port_probability_daily", "port_hit_summary",
    "port_status_share", "prepare_flows", "production_ratio_daily", "record_low_flows", "sample_sources",
    "saved_flows", "source_sample", "strategies_by_port", "strategy_long", "strategy_pair_comparison",
    "strategy_parameter_grid", "strategy_scoring", "strategy_setup_summary",
    "strategy_sweep", "sweep_certificate", "sweep_records", "top_attacked_ports", "unused_hosts_per_port",
]
