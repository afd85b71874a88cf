"""Interval operators: the sweep over span edges, all-or-nothing, splitting recordings, ticks to recordings.

Spans: recspan_id, start, stop, and epoch_id (null for artifacts), request, flagged, intrinsic (names), artifact (a name,
null for epochs). Pieces: recspan_id, lo, hi, epochs (sorted), artifacts (sorted names), one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAUSE, DELETE = 49152, 57344
ALL_OR_NOTHING = "_ALL_OR_NOTHING"


def covering(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``points`` (recspan_id, lo, ...) joined with the ``spans`` (recspan_id, start, stop, ...) that hold the tick lo.

    A recording's time is cut into buckets as long as its spans are on average, so that spans become about two rows each and
    the join is one of equal (recspan_id, bucket), spread over many tasks however long the recording is."""
    width = spans.groupBy("recspan_id").agg(F.greatest(F.ceil(F.avg(F.col("stop") - F.col("start"))), F.lit(1)).cast("long").alias("_w"))
    cut = spans.join(width, "recspan_id").withColumn("_b", F.explode(F.expr("sequence(start div _w, (stop - 1) div _w)"))).drop("_w")
    at = points.join(width, "recspan_id").withColumn("_b", F.expr("lo div _w")).drop("_w")
    return at.join(cut, ["recspan_id", "_b"]).where("start <= lo AND stop > lo").drop("_b")


def subspans(epochs: DataFrame, artifacts: DataFrame, overlap_correction: bool = True) -> DataFrame:
    """The maximal pieces between consecutive edges that at least one epoch covers. ``epochs``: epoch_id, recspan_id, start,
    stop, intrinsic; ``artifacts``: recspan_id, start, stop, artifact. With overlap correction a piece belongs to all its
    epochs and has the artifacts of any; without, each epoch has its own copy, with its own intrinsic ones."""
    bounds = epochs.groupBy("recspan_id").agg(F.min("start").alias("_lo"), F.max("stop").alias("_hi"))
    # Clipped to where epochs are, so that open-ended artifacts make no pieces of their own.
    art = artifacts.join(bounds, "recspan_id").select("recspan_id", F.greatest("start", "_lo").alias("start"), F.least("stop", "_hi").alias("stop"), "artifact").where("start < stop")
    edges = epochs.select("recspan_id", F.explode(F.array("start", "stop")).alias("lo")).unionByName(art.select("recspan_id", F.explode(F.array("start", "stop")).alias("lo"))).distinct()
    gaps = edges.withColumn("hi", F.lead("lo").over(W.partitionBy("recspan_id").orderBy("lo"))).where("hi IS NOT NULL")
    # No edge lies inside a piece: what holds its first tick holds all of it.
    by_epoch = covering(gaps, epochs.select("recspan_id", "start", "stop", "epoch_id", "intrinsic"))
    keys = ["recspan_id", "lo", "hi"]
    of_piece = covering(gaps, art).groupBy(*keys).agg(F.collect_set("artifact").alias("regular"))
    if overlap_correction:
        pieces = by_epoch.groupBy(*keys).agg(F.sort_array(F.collect_list("epoch_id")).alias("epochs"), F.flatten(F.collect_list("intrinsic")).alias("intrinsic"))
    else:
        pieces = by_epoch.select(*keys, F.array("epoch_id").alias("epochs"), "intrinsic")
    none = F.expr("cast(array() AS array<string>)")
    out = pieces.join(of_piece, keys, "left")
    return out.select(*keys, "epochs", F.array_sort(F.array_distinct(F.concat("intrinsic", F.coalesce("regular", none)))).alias("artifacts"))


def all_or_nothing(epochs: DataFrame, artifacts: DataFrame, overlap_correction: bool = True) -> DataFrame:
    """(epoch_id) of the flagged epochs that go because they, or what they are chained to, hold an artifact anywhere.

    Flagged epochs without intrinsic artifacts overlap in islands along the line; one bad piece dooms an island. Without
    overlap correction nothing chains."""
    nodes = epochs.where(F.col("flagged") & (F.size("intrinsic") == 0))
    pieces = subspans(epochs, artifacts, overlap_correction).where("size(artifacts) > 0")
    hit = pieces.select(F.explode("epochs").alias("epoch_id")).distinct()
    seeds = nodes.join(hit, "epoch_id", "left_semi").select("epoch_id")
    if not overlap_correction:
        return seeds
    before = W.partitionBy("recspan_id").orderBy("start", "stop", "epoch_id")
    reach = F.max("stop").over(before.rowsBetween(W.unboundedPreceding, -1))
    islands = nodes.withColumn("_new", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1))).withColumn("island", F.sum("_new").over(before))
    doomed = islands.join(seeds, "epoch_id", "left_semi").select("recspan_id", "island").distinct()
    return islands.join(doomed, ["recspan_id", "island"], "left_semi").select("epoch_id")


def tag_all_or_nothing(epochs: DataFrame, doomed: DataFrame) -> DataFrame:
    marked = epochs.join(doomed.withColumn("_doomed", F.lit(True)), "epoch_id", "left")
    return marked.withColumn("intrinsic", F.when(F.col("_doomed"), F.array_append("intrinsic", F.lit(ALL_OR_NOTHING))).otherwise(F.col("intrinsic"))).drop("_doomed")


def split_recspans(codes: DataFrame, by: str | None = None) -> DataFrame:
    """``codes`` (tick, code) with recspan and its tick inside it: a pause or delete code ends the recording it is in."""
    key = [by] if by else []
    order = W.partitionBy(*key).orderBy("tick")
    ends = F.coalesce(F.lag(F.col("code").isin(PAUSE, DELETE).cast("int")).over(order), F.lit(0))
    out = codes.withColumn("_ends", ends).withColumn("recspan", F.sum("_ends").over(order))
    first = F.min("tick").over(W.partitionBy(*key, "recspan"))
    return out.withColumn("recspan_tick", F.col("tick") - first).drop("_ends")


def locate_ticks(ticks: DataFrame, spans: DataFrame) -> DataFrame:
    """``ticks`` (tick) joined with the one of ``spans`` (recspan_id, start, stop) it lies in."""
    return ticks.join(spans, (F.col("tick") >= F.col("start")) & (F.col("tick") < F.col("stop")))


def overlapping_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id) of events that overlap: equal recording, and half-open ticks in common. Of two that do, one holds the
    other's first tick: either b's start lies in a, or a's start lies in b behind b's own."""
    def spans(df, name):
        return df.select(F.col("event_id").alias(name), "recspan_id", F.col("start_tick").alias("start"), F.col("stop_tick").alias("stop"))

    def points(df, name):
        return df.select(F.col("event_id").alias(name), "recspan_id", F.col("start_tick").alias("lo"))

    first = covering(points(b, "b_id"), spans(a, "a_id"))
    second = covering(points(a, "a_id"), spans(b, "b_id")).where("start < lo")
    return first.select("a_id", "b_id", "recspan_id").unionByName(second.select("a_id", "b_id", "recspan_id"))


def magnitude(length: Column) -> Column:
    """The power of two that a span's length is counted under: 1 for one tick, else the largest one below the length."""
    return F.when(length == 1, 1.0).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(length)) - 1))
