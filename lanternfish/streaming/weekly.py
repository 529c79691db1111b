"""Weekly demand as a stream: tumbling weeks with a watermark, slots deduplicated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stamped(events: DataFrame, ts: str) -> DataFrame:
    """events with ts as a timestamp; one that is one already keeps its watermark."""
    return events if dict(events.dtypes)[ts] == "timestamp" else events.withColumn(ts, F.col(ts).cast("timestamp"))


def weekly_counts(events: DataFrame, key: str = "event_type", ts: str = "ts", value: str = "value", late: str | None = "2 days") -> DataFrame:
    """(week_start, week_ending, key, n, total) of a stream or a table of events.

    Weeks start on Monday and end on Sunday. As a stream in append mode a week comes out
    once the watermark has passed its end; later rows of it are dropped, by definition.
    late None: the stream has a watermark already.
    """
    w = F.window(ts, "7 days", "7 days", "4 days")
    g = _stamped(events, ts)
    g = (g.withWatermark(ts, late) if events.isStreaming and late else g).groupBy(w.alias("w"), key)
    out = g.agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    start = F.to_date("w.start")
    return out.select(start.alias("week_start"), F.date_add(start, 6).alias("week_ending"), key, "n", "total")


def deduplicated(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "2 days") -> DataFrame:
    """First of rows with equal keys; a stream remembers keys within the watermark only."""
    if events.isStreaming:
        return _stamped(events, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)
