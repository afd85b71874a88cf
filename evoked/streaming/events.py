"""Extensions over streams: queries are predicates, so they work on streams of events as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoked.operators.timeline import Timeline


def find(stream: DataFrame, timeline: Timeline, restrict) -> DataFrame:
    """The events of a stream that a query about events alone matches."""
    where, joined = timeline.predicate(restrict)
    if joined:
        raise ValueError("recordings' attributes need a join with the recordings")
    return stream.where(where)


def windowed_means(stream: DataFrame, time: str, width: str, late: str, channels, *keys: str) -> DataFrame:
    """Means of channels over tumbling windows, dropping what comes later than ``late``."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return w.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in channels))
