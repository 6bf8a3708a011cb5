"""Parsing of the archive's StartTime text.

Times are wall-clock values without a zone, so they become TIMESTAMP_NTZ by casts that
never pass through the session time zone (a night when clocks change stays as written).
The layout is strict: 24-hour time with up to six fraction digits; other text gives NULL.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlure.config import START_DAY_PATTERN, START_TIME_PATTERN


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flow_timestamp(start_time="StartTime") -> Column:
    """``yyyy/MM/dd HH:mm:ss[.SSSSSS]`` text -> TIMESTAMP_NTZ (NULL when malformed)."""
    text = _col(start_time)
    dashed = F.replace(text, F.lit("/"), F.lit("-")).try_cast("timestamp_ntz")
    return F.when(text.rlike(START_TIME_PATTERN), dashed)


def flow_day(start_time="StartTime") -> Column:
    """Day of the flow from the ``yyyy/MM/dd`` prefix of StartTime -> DATE (NULL when malformed)."""
    text = F.substring(_col(start_time), 1, 10)
    return F.when(text.rlike(START_DAY_PATTERN), F.replace(text, F.lit("/"), F.lit("-")).try_cast("date"))
