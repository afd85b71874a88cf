"""Signals: range scans, linear transforms, and epochs cut around events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoked.operators.timeline import numbered


def raw_slice(signal: DataFrame, recspan_id: int, start_tick: int, stop_tick: int) -> DataFrame:
    """Ticks [start, stop) of one recording; the filter reaches the scan. Missing ticks are an error."""
    if start_tick < 0 or stop_tick < start_tick:
        raise IndexError("slices begin at tick 0 or later and end no earlier than they begin")
    out = signal.where((F.col("recspan_id") == recspan_id) & (F.col("tick") >= start_tick) & (F.col("tick") < stop_tick))
    if out.count() != stop_tick - start_tick:
        raise IndexError("slice spans missing data")
    return out


def transform(signal: DataFrame, channels, matrix) -> DataFrame:
    """Every sample row y becomes y times the transposed ``matrix``: one projection."""
    def row(coefs):
        parts = [F.col(c) if k == 1 else F.lit(float(k)) * F.col(c) for k, c in zip(coefs, channels, strict=True) if k]
        out = parts[0] if parts else F.lit(0.0)
        for p in parts[1:]:
            out = out + p
        return out

    rest = [c for c in signal.columns if c not in channels]
    return signal.select(*rest, *(row(r).alias(c) for r, c in zip(matrix, channels, strict=True)))


def compose(first, then) -> list[list[float]]:
    """The matrix of two transforms in a row."""
    return [[sum(a * b for a, b in zip(row, col, strict=True)) for col in zip(*first, strict=True)] for row in then]


def epoch_rows(events: DataFrame, signal: DataFrame, start: int, stop: int, extra=()) -> DataFrame:
    """(event_id, extra, recspan_id, latency_tick, channels) for the ticks [start, stop) around each event's start. Events
    are exploded to ticks, so that the join is one of equal keys."""
    at = events.select("event_id", *extra, "recspan_id", "start_tick", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(stop - 1).cast("long"))).alias("latency_tick"))
    at = at.withColumn("tick", F.col("start_tick") + F.col("latency_tick")).drop("start_tick")
    return at.join(signal, ["recspan_id", "tick"])


def epochs(events: DataFrame, signal: DataFrame, recspans: DataFrame, start: int, stop: int, incomplete: str = "raise") -> DataFrame:
    """Epochs as long rows with epoch_no, the event's number among all that matched. Windows that leave their recording
    raise, or are dropped."""
    if incomplete not in ("raise", "drop"):
        raise ValueError(f"unknown action {incomplete!r}")
    placed = events.join(recspans.select("recspan_id", "ticks"), "recspan_id")
    fits = (F.col("start_tick") + start >= 0) & (F.col("start_tick") + stop <= F.col("ticks"))
    placed = numbered(placed, "epoch_no", "start_tick", "event_id")
    if incomplete == "raise" and not placed.where(~fits).isEmpty():
        raise ValueError("an epoch leaves its recording")
    return epoch_rows(placed.where(fits), signal, start, stop, extra=("epoch_no",))
