"""What was requested, kept and rejected, over all and for each request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoked.operators.intervals import ALL_OR_NOTHING


def _buckets(pieces: DataFrame, requests: DataFrame) -> DataFrame:
    """A row for each piece and bucket (null: all requests): ticks, how many of the bucket's epochs it has, and of all."""
    kind = pieces.schema["epochs"].dataType.elementType
    # The null after a piece's epochs stands for all requests.
    each = pieces.select("recspan_id", "lo", "hi", "artifacts", F.element_at("epochs", 1).alias("_first"), F.size("epochs").alias("n_all"), F.explode(F.concat("epochs", F.array(F.lit(None).cast(kind)))).alias("epoch_id"))
    each = each.join(requests.select("epoch_id", "request"), "epoch_id", "left").where("epoch_id IS NULL OR request IS NOT NULL")
    own = each.groupBy("recspan_id", "lo", "hi", "_first", "request").agg(F.first("artifacts").alias("artifacts"), F.first("n_all").alias("n_all"), F.count("*").alias("n"))
    return own.withColumns({"_ticks": F.col("hi") - F.col("lo"), "n": F.when(F.col("request").isNull(), F.col("n_all").cast("long")).otherwise(F.col("n"))})


def point_stats(pieces: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, ticks, event_ticks and no_overlap_ticks, each requested and accepted). ``requests``: epoch_id, request."""
    b, clean = _buckets(pieces, requests), F.size("artifacts") == 0
    amount = {"ticks": F.col("_ticks"), "event_ticks": F.col("_ticks") * F.col("n"), "no_overlap_ticks": F.when(F.col("n_all") == 1, F.col("_ticks")).otherwise(0)}
    aggs = [F.sum(v).cast("long").alias(f"{k}_requested") for k, v in amount.items()] + [F.sum(F.when(clean, v).otherwise(0)).cast("long").alias(f"{k}_accepted") for k, v in amount.items()]
    return b.groupBy("request").agg(*aggs)


def artifact_stats(pieces: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, artifact, affected, unique ticks). All-or-nothing counts only where nothing else is to blame."""
    b = _buckets(pieces, requests)
    real = F.filter("artifacts", lambda a: a != ALL_OR_NOTHING)
    b = b.withColumn("_why", F.when(F.size(real) > 0, real).otherwise(F.col("artifacts")))
    each = b.select("request", "_ticks", F.explode("_why").alias("artifact"), F.size("_why").alias("_k"))
    return each.groupBy("request", "artifact").agg(F.sum("_ticks").cast("long").alias("affected"), F.sum(F.when(F.col("_k") == 1, F.col("_ticks")).otherwise(0)).cast("long").alias("unique"))


def epoch_stats(pieces: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, requested, fully_accepted, partially_accepted, fully_rejected) epochs; null: all requests."""
    good = F.size("artifacts") == 0
    each = pieces.select(F.explode("epochs").alias("epoch_id"), good.alias("g")).groupBy("epoch_id").agg(F.bool_and("g").alias("every"), F.bool_or("g").alias("some"))
    rows = each.join(requests.select("epoch_id", "request"), "epoch_id")
    rows = rows.unionByName(rows.withColumn("request", F.lit(None).cast("int")))
    return rows.groupBy("request").agg(F.count("*").alias("requested"), F.count_if("every").alias("fully_accepted"), F.count_if(F.col("some") & ~F.col("every")).alias("partially_accepted"), F.count_if(~F.col("some")).alias("fully_rejected"))


def choose_strategy(asked: str, points: dict, epochs: dict) -> str:
    """by-epoch or continuous. By-epoch is possible if no accepted ticks overlap and no epoch is accepted in part."""
    against = []
    if points["event_ticks_accepted"] > points["ticks_accepted"]:
        against.append("epochs overlap")
    if epochs["partially_accepted"]:
        against.append("epochs are accepted in part")
    if asked == "auto":
        return "continuous" if against else "by-epoch"
    if asked == "by-epoch" and against:
        raise ValueError("by-epoch regression is not possible: " + " and ".join(against))
    if asked not in ("by-epoch", "continuous"):
        raise ValueError(f"unknown regression strategy {asked!r}")
    return asked


def report(points: dict, epochs: dict, artifacts: dict | None = None) -> str:
    """What was accepted and rejected, as text; of rows of ``point_stats``, ``epoch_stats`` and ``artifact_stats``."""
    share = lambda n, of: f"{n} of {of}" + (f" ({100 * n / of:.1f}%)" if of else "")
    asked = epochs["requested"]
    lines = [f"epochs: {asked}", *(f"  {k.replace('_', ' ')}: {share(epochs[k], asked)}" for k in ("fully_accepted", "partially_accepted", "fully_rejected"))]
    for name in ("ticks", "event_ticks", "no_overlap_ticks"):
        lines.append(f"{name.replace('_', ' ')} accepted: {share(points[name + '_accepted'], points[name + '_requested'])}")
    lines += [f"  {a}: {v['affected']} ticks, {v['unique']} by it alone" for a, v in sorted((artifacts or {}).items())]
    if points["ticks_accepted"]:
        lines.append(f"events per accepted tick: {overlap_ratio(points):.2f}")
    return "\n".join(lines)


def overlap_ratio(points: dict) -> float:
    """Events per accepted tick; above 1, epochs overlap. NaN if no tick was accepted."""
    return points["event_ticks_accepted"] / points["ticks_accepted"] if points["ticks_accepted"] else float("nan")
