"""Keyed pseudo-random rolls.

A roll is the first 32 bits of md5 over the '|'-joined key, divided by 2**32: uniform in
[0, 1), the same on every executor, on every re-execution after a lost task and in any SQL
engine with md5. Rows equal in every key field share a roll.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_POW_32 = 4294967296.0
ROLL_TIME_DIGITS = 20  # yyyyMMddHHmmss and six fraction digits


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keyed_roll(*parts) -> Column:
    """Uniform [0, 1) value keyed by the given string columns (NULL parts are skipped)."""
    key = F.concat_ws("|", *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(_TWO_POW_32)


def flow_roll(tag: str, src="SrcAddr", dst="DstAddr", port="Dport", ts="ts") -> Column:
    """Roll of one flow: key ``SrcAddr|DstAddr|Dport|yyyyMMddHHmmssSSSSSS|tag``."""
    # The text of a TIMESTAMP_NTZ has no zone; its trailing zeros are left out, so pad.
    digits = F.rpad(F.regexp_replace(_col(ts).cast("string"), r"\D", ""), ROLL_TIME_DIGITS, "0")
    return keyed_roll(src, dst, port, digits, F.lit(str(tag)))


def keyed_sample(key="SrcAddr", rate: float = 0.01, seed=42) -> Column:
    """Membership test of a keyed Bernoulli sample: the same key is always in or out."""
    return keyed_roll(key, F.lit(str(seed))) < F.lit(float(rate))
