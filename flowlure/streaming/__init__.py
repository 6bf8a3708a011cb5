"""Incremental runs of the daily jobs over a growing flow archive (Structured Streaming)."""

from flowlure.streaming.daily import start_daily_statistics_stream, update_daily_statistics

__all__ = ["start_daily_statistics_stream", "update_daily_statistics"]
