"""Counting later events per mark without a per-row fan-out over hot keys.

``count_after(marks, events, keys, ...)`` gives, for every mark row, the number of event
rows with the same ``keys`` and a strictly later time. A plain join on ``keys`` would pair
each mark with every event of its key: for a source that sends millions of flows a day,
times the number of strategies. Here events are added up per key and microsecond in the
tasks that read them, so the exchange carries counts; marks are placed among those counts,
and one running sum per level gives what is later: minutes after the mark's own, and times
after its own in that minute. Work is linear in marks plus counts, and no window holds more
than the minutes of a day or the microseconds of a minute of one key. All of it is exact;
``keys`` must include the day so times of day are comparable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def microsecond_of_minute(ts: Column) -> Column:
    return (F.extract(F.lit("SECOND"), ts) * 1000000).cast("int")


def _timed(df: DataFrame, keys: list[str], time: str, *columns: str) -> DataFrame:
    """Rows with a time: their keys as one struct, minute of the day and microsecond of the minute.

    A struct is no column that an earlier join dealt rows by, so an aggregate or window on it
    and the minute always gets an exchange of its own, after the partial counts; on the bare
    keys it would accept that join's partitioning and count a hot key in one task.
    """
    t = F.col(time)
    return df.where(t.isNotNull()).select(F.struct(*keys).alias("_k"), minute_of_day(t).alias("_m"),
                                          microsecond_of_minute(t).alias("_u"), *columns)


def _later(marks: DataFrame, counts: DataFrame, group: list[str], order: str, mark: str, out: str) -> DataFrame:
    """Per mark, the sum of ``_n`` over rows of its group with a greater ``order``."""
    # Both sides carry all columns; a count row has no mark, a mark counts nothing.
    rows = counts.select(*group, order, "_n", F.lit(None).cast(marks.schema[mark].dataType).alias(mark))
    rows = rows.unionByName(marks.select(*group, order, F.lit(0).cast("long").alias("_n"), mark))
    after = Window.partitionBy(*group).orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.sum("_n").over(after)).where(F.col(mark).isNotNull() & (F.col(out) > 0)).select(f"{mark}.*", out)


def later_parts(marks: DataFrame, events: DataFrame, keys: list[str], mark_id: list[str],
                mark_time: str = "ts", event_time: str = "ts", out: str = "later") -> DataFrame:
    """Rows of ``mark_id`` + ``out`` whose sums per mark are :func:`count_after`: for callers that add up anyway."""
    times = _timed(events, keys, event_time).groupBy("_k", "_m", "_u").agg(F.count("*").alias("_n"))
    minutes = times.groupBy("_k", "_m").agg(F.sum("_n").alias("_n"))
    named = marks.withColumn("_mark", F.struct(*mark_id))
    m = _timed(named, keys, mark_time, "_mark")
    return (_later(m, minutes, ["_k"], "_m", "_mark", out)
            .unionByName(_later(m, times, ["_k", "_m"], "_u", "_mark", out)))


def count_after(marks: DataFrame, events: DataFrame, keys: list[str], mark_id: list[str],
                mark_time: str = "ts", event_time: str = "ts", out: str = "later") -> DataFrame:
    """Per mark (identified by ``mark_id``, which includes ``keys``): events strictly after it.

    Returns ``mark_id`` + ``out``; marks without a later event are absent.
    """
    return later_parts(marks, events, keys, mark_id, mark_time, event_time, out).groupBy(*mark_id).agg(F.sum(out).alias(out))
