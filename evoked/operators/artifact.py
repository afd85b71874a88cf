"""Artifact detectors over single channels. Runs end where the data says, which no window frame expresses, so these read
sorted recordings in Arrow batches; a batch's open runs wait for the next one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evoked.functions.attrs import ATTR
from evoked.operators.timeline import Timeline


def flat_lengths(limit: float, data, groups=None) -> np.ndarray:
    """For each place the length of the longest run from there in which max - min is at most ``limit``, within its group.

    Extrema of windows of 1, 2, 4, ... places are kept as long as any such window is flat; each place then adds the largest
    windows that fit, from the longest down."""
    data = np.asarray(data, float)
    n = len(data)
    # Where a group's last place is: windows must not go beyond.
    end = np.full(n, n)
    if groups is not None and n:
        ends = np.flatnonzero(np.append(groups[1:] != groups[:-1], True)) + 1
        end = np.repeat(ends, np.diff(ends, prepend=0))
    high, low, levels, size = data, data, [], 1
    while len(high) and size <= n:
        fits = (high - low <= limit) & (np.arange(len(high)) + size <= end[: len(high)])
        if not fits.any():
            break
        levels.append((size, high, low))
        high, low, size = np.maximum(high[:-size], high[size:]), np.minimum(low[:-size], low[size:]), 2 * size
    at, top, bottom = np.arange(n), np.full(n, -np.inf), np.full(n, np.inf)
    for size, high, low in reversed(levels):
        there = at + size <= end
        k = np.where(there, at, 0)
        up, down = np.maximum(top, high[k]), np.minimum(bottom, low[k])
        step = there & (up - down <= limit)
        at, top, bottom = np.where(step, at + size, at), np.where(step, up, top), np.where(step, down, bottom)
    return at - np.arange(n)


def flat_spans(signal: DataFrame, channel: str, limit: float) -> DataFrame:
    """(recspan_id, tick, length)."""

    def run(batches):
        held, settled = None, 0
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            # Places before ``settled`` were tried already and are open; they wait until the buffer has doubled.
            if len(held) >= 2 * settled:
                out, held = split(held)
                settled = len(held)
                yield out
        if held is not None:
            yield held.assign(length=lengths(held))[["recspan_id", "tick", "length"]]

    def lengths(rows: pd.DataFrame) -> np.ndarray:
        return flat_lengths(limit, rows["x"], rows["recspan_id"].to_numpy())

    def split(rows: pd.DataFrame):
        size = lengths(rows)
        # Runs that reach the end of the buffer may go on; ends never go back, so these are the last rows.
        closed = int(np.searchsorted(np.arange(len(rows)) + size, len(rows)))
        return rows[:closed].assign(length=size[:closed])[["recspan_id", "tick", "length"]], rows[closed:].reset_index(drop=True)

    rows = signal.select("recspan_id", F.col("tick").cast("long"), F.col(channel).cast("double").alias("x"))
    rows = rows.repartition("recspan_id").sortWithinPartitions("recspan_id", "tick")
    return rows.mapInPandas(run, f"recspan_id {dict(signal.dtypes)['recspan_id']}, tick long, length long")


def find_flat_spans(signal: DataFrame, channel: str, max_variation: float, min_length: int, pad: int = 0, maximal: bool = False) -> DataFrame:
    """(recspan_id, start, stop), widened by ``pad``: from every tick the longest flat run, if longer than ``min_length``;
    only those that no earlier one holds, if ``maximal``."""
    runs = flat_spans(signal, channel, max_variation)
    if maximal:
        at = W.partitionBy("recspan_id").orderBy("tick")
        runs = runs.withColumn("_before", F.max(F.col("tick") + F.col("length")).over(at.rowsBetween(W.unboundedPreceding, -1)))
        runs = runs.where(F.col("_before").isNull() | (F.col("tick") + F.col("length") > F.col("_before")))
    return runs.where(F.col("length") > min_length).select("recspan_id", (F.col("tick") - pad).alias("start"), (F.col("tick") + F.col("length") + pad).alias("stop"))


def reject_flat(t: Timeline, signal: DataFrame, channel: str, max_variation: float, min_length: int, name: str = "flat") -> Timeline:
    """The timeline with an event of the artifact type ``name`` for each maximal flat run."""
    runs = find_flat_spans(signal, channel, max_variation, min_length, maximal=True)
    value = F.struct(F.lit(None).cast("bigint").alias("l"), F.lit(None).cast("double").alias("d"), F.lit(name).alias("s"), F.lit(None).cast("boolean").alias("b"))
    attrs = F.create_map(F.lit("_ARTIFACT_TYPE"), value).cast(f"map<string,{ATTR}>")
    return t.add_events(runs.select("recspan_id", F.col("start").alias("start_tick"), F.col("stop").alias("stop_tick"), attrs.alias("attrs")), {"_ARTIFACT_TYPE": "text"})


def peak_to_peak(signal: DataFrame, channel: str, ticks: int) -> DataFrame:
    """(recspan_id, tick, range) of the last ``ticks`` samples."""
    w = W.partitionBy("recspan_id").orderBy("tick").rowsBetween(1 - ticks, 0)
    return signal.select("recspan_id", "tick", (F.max(channel).over(w) - F.min(channel).over(w)).alias("range"))
