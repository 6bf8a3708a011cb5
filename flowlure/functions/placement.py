"""Honeypot placement rules (native expressions replacing per-row Python)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def place_by_probability(roll="roll", prob="prob") -> Column:
    """A honeypot sits on the flow's port when the roll does not exceed the strategy's probability."""
    return _col(roll) <= _col(prob)


def place_by_ratio(ratio="ratio", prob="prob", roll="roll") -> Column:
    """Scale placement by the share of hosts that could take a honeypot on the port.

    Always placed when ``ratio <= prob``; otherwise placed with probability ``prob / ratio``.
    """
    ratio, prob, roll = _col(ratio), _col(prob), _col(roll)
    return (ratio <= prob) | (roll < F.try_divide(prob, ratio))
