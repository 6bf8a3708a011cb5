"""Column expressions. All are native Spark expressions (whole-stage codegen, no Python)."""

from flowlure.functions.placement import place_by_probability, place_by_ratio
from flowlure.functions.roll import flow_roll, keyed_roll, keyed_sample
from flowlure.functions.states import answered, unused_port
from flowlure.functions.timeparse import flow_day, flow_timestamp

__all__ = [
    "answered", "flow_day", "flow_roll", "flow_timestamp", "keyed_roll", "keyed_sample",
    "place_by_probability", "place_by_ratio", "unused_port",
]
