"""Flow state classes.

State strings look like ``<source flags>_<destination flags>``. The two classes are not
complements: ``S_SR`` and ``INT`` are neither, ``A_SPA_RA`` is both. A NULL state gives
NULL in both, so filters on either class drop the row.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlure.config import ANSWERED_PATTERN, UNUSED_PORT_PATTERN


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unused_port(state="State") -> Column:
    """True when the destination never sent a SYN back: the port is unused (honeypot candidate)."""
    return _col(state).rlike(UNUSED_PORT_PATTERN)


def answered(state="State") -> Column:
    """True when the destination answered with SYN and later ACK: a production service."""
    return _col(state).rlike(ANSWERED_PATTERN)
