"""Counts and sums of events in tumbling, sliding and session windows, of a table or of a stream.

On a stream, a window is given out once the watermark (the latest event time less ``late``) has passed its end, and an event
whose windows have all been given out is dropped. On a table nothing is late. Sessions of a user end after a gap without
events; a session's state is one row.

Defined results: events without a time are left out; a null user or type is a group of its own; an event at a window's end
belongs to the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(events: DataFrame, window: Column, by: list[str], late: str) -> DataFrame:
    timed = events.filter("ts is not null").withWatermark("ts", late)
    sums = timed.groupBy(window.alias("window"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def tumbling(events: DataFrame, width: str, late: str = "2 hours") -> DataFrame:
    return _counted(events, F.window("ts", width), ["event_type"], late)


def sliding(events: DataFrame, width: str, slide: str, late: str = "2 hours") -> DataFrame:
    """Windows of ``width`` that begin every ``slide``: an event is in width / slide of them."""
    return _counted(events, F.window("ts", width, slide), ["event_type"], late)


def sessions(events: DataFrame, gap: str, late: str = "2 hours") -> DataFrame:
    """Each user's runs of events with less than ``gap`` between them; a session ends ``gap`` after its last event."""
    return _counted(events, F.session_window("ts", gap), ["user_id"], late)
