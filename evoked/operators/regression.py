"""Regression-based event-related averages.

Requests become epochs with a design row each; the sweep gives the clean pieces; what is left of the signal is reduced on
the cluster to sufficient statistics, and the small system is solved on the driver. By-epoch fits take the condition of
the design from a distributed QR (X itself, not its square); continuous fits from X'X, as their sums are all they need.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoked.functions.attrs import ColumnAttrs
from evoked.functions.data_format import DataFormat
from evoked.operators import accounting
from evoked.operators.intervals import all_or_nothing, subspans, tag_all_or_nothing
from evoked.operators.timeline import Timeline
from evoked.plans.formula import Design, compile_formula

MAX_CONDITION = 1e7
FAR = 2**31
#: Tasks that the triangles of all partitions are merged in before the driver gets them.
MERGERS = 8
#: Columns (predictors by latencies) of a continuous fit: its square system is held and solved on the driver.
MAX_COLUMNS = 10_000


@dataclass(frozen=True)
class Request:
    event_query: object
    start_time: float
    stop_time: float
    formula: str
    name: str | None = None
    bad_event_query: object = None
    all_or_nothing: bool = False

    def __post_init__(self):
        if self.stop_time < self.start_time:
            raise ValueError("the window ends before it starts")
        if self.name is None:
            object.__setattr__(self, "name", f"{self.event_query}: {self.formula}")


@dataclass
class Fit:
    """betas: request, predictor_idx, predictor, latency_tick, latency_ms, and a column for each channel."""

    request: Request
    betas: DataFrame
    design: Design
    global_stats: dict
    this_stats: dict
    regression_strategy: str
    overlap_correction: bool
    timeline: Timeline = field(repr=False)

    def report(self) -> str:
        own = self.this_stats
        return accounting.report(own["points"], own["epochs"], own.get("artifacts"))

    def overlap_ratio(self) -> float:
        return accounting.overlap_ratio(self.global_stats["points"])

    def predict_many(self, predictors: DataFrame, which_terms=None, na_action: str = "raise") -> DataFrame:
        """``predictors`` (row_id, columns of the formula) with the response at each latency."""
        if na_action not in ("raise", "drop"):
            raise ValueError(f"unknown action {na_action!r}")
        array = predict_design(predictors, self.design)
        rows = predictors.select("row_id", array.alias("x"))
        if na_action == "raise" and not rows.where("x IS NULL").isEmpty():
            raise ValueError("predictors with nulls")
        keep = set(range(len(self.design.names)))
        if which_terms is not None:
            known = dict(self.design.terms)
            keep = {i for t in which_terms for i in known[t]}
        x = rows.where("x IS NOT NULL").select("row_id", F.posexplode("x").alias("predictor_idx", "value")).where(F.col("predictor_idx").isin(sorted(keep)))
        channels = [c for c in self.betas.columns if c not in ("request", "predictor_idx", "predictor", "latency_tick", "latency_ms")]
        return x.join(self.betas, "predictor_idx").groupBy("row_id", "latency_tick", "latency_ms").agg(*(F.sum(F.col("value") * F.col(c)).alias(c) for c in channels))

    def predict(self, predictors: DataFrame, which_terms=None, na_action: str = "raise") -> DataFrame:
        if predictors.count() != 1:
            raise ValueError("predict takes one row")
        return self.predict_many(predictors, which_terms, na_action)


def predict_design(predictors: DataFrame, design: Design):
    """The array column of a fitted design over new rows: levels and names are those of the fit."""
    attrs = ColumnAttrs.of(predictors, [c for c in predictors.columns if c != "row_id"])
    out = []
    for name in design.names:
        value = F.lit(1.0)
        for part in name.split(":") if name != "Intercept" else []:
            if part.endswith("]"):
                factor, _, level = part[:-1].partition("[")
                key = factor[2:-1] if factor.startswith("C(") else factor
                value = value * (attrs.value(key).cast("string") == level.removeprefix("T.")).cast("double")
            else:
                one = compile_formula(f"0 + {part}", predictors, attrs)
                value = value * one.array[0]
        out.append(value)
    array = F.array(*out)
    for v in out:
        array = F.when(v.isNotNull(), array)
    return array


def artifact_spans(t: Timeline, query: object = "has _ARTIFACT_TYPE", type_field: str | None = "_ARTIFACT_TYPE") -> DataFrame:
    """recspan_id, start, stop, artifact: what is outside of recordings, and the events that the query matches."""
    r = t.recspans.select("recspan_id", "ticks")
    before = r.select("recspan_id", F.lit(-FAR).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"), F.lit("_NO_RECORDING").alias("artifact"))
    after = r.select("recspan_id", F.col("ticks").cast("long").alias("start"), F.lit(FAR).cast("long").alias("stop"), F.lit("_NO_RECORDING").alias("artifact"))
    unknown = F.lit("_UNKNOWN")
    kind = unknown
    if type_field is not None:
        if t.attrs.kind(type_field) not in (None, "text"):
            raise TypeError(f"{type_field} is not a text attribute")
        if t.attrs.kind(type_field) == "text":
            kind = F.coalesce(t.attrs.value(type_field), unknown)
    own = t.find(query).select("recspan_id", F.col("start_tick").alias("start"), F.col("stop_tick").alias("stop"), kind.alias("artifact"))
    return before.unionByName(after).unionByName(own)


def epoch_spans(t: Timeline, fmt: DataFormat, requests: list[Request], registered=None) -> tuple[DataFrame, list[Design], list[tuple[int, int]]]:
    """epoch_id, request, event_id, recspan_id, at, start, stop, flagged, intrinsic, x; the designs; the windows in ticks."""
    parts, designs, windows = None, [], []
    for i, r in enumerate(requests):
        start, stop = fmt.ms_span_to_ticks(r.start_time, r.stop_time)
        if start >= stop:
            raise ValueError("the window holds no tick")
        where = t.predicate(r.event_query)[0]
        found = t.with_recspans().where(where)
        if found.isEmpty():
            raise ValueError(f"no events match {r.event_query!r}")
        design = compile_formula(r.formula, found, t.attrs, t.recspan_attrs, registered)
        found = found.withColumn("x", design.array)
        bad = F.lit(False)
        if r.bad_event_query is not None:
            bad = F.coalesce(t.predicate(r.bad_event_query)[0], F.lit(False))
        tags = F.array_compact(F.array(F.when(F.col("x").isNull(), F.lit("_MISSING_PREDICTOR")), F.when(bad, F.lit("_BAD_EVENT_QUERY"))))
        rows = found.select(
            F.struct(F.lit(i).alias("r"), "event_id").alias("epoch_id"), F.lit(i).alias("request"), "event_id", "recspan_id", F.col("start_tick").alias("at"),
            (F.col("start_tick") + start).alias("start"), (F.col("start_tick") + stop).alias("stop"), F.lit(r.all_or_nothing).alias("flagged"), tags.alias("intrinsic"), "x",
        )
        parts = rows if parts is None else parts.unionByName(rows)
        designs.append(design)
        windows.append((start, stop))
    return parts, designs, windows


def triangle(rows: DataFrame, width: int) -> np.ndarray:
    """The R of a QR of the array column x: the R of each partition, of ``MERGERS`` groups of them, then of all on the driver,
    which gets at most ``MERGERS`` of width x width."""

    def reduce(batches):
        held = np.zeros((0, width))
        for b in batches:
            if len(b):
                held = np.linalg.qr(np.vstack([held, np.vstack(b["x"].to_numpy())]), mode="r")
        if len(held):
            yield pd.DataFrame({"x": [row.tolist() for row in held]})

    one = rows.select("x").mapInPandas(reduce, "x array<double>").repartition(MERGERS)
    parts = one.mapInPandas(reduce, "x array<double>").select(F.col("x").alias("r")).collect()
    return np.linalg.qr(np.array([p.r for p in parts]), mode="r") if parts else np.zeros((0, width))


def fit_by_epoch(epochs: DataFrame, signal: DataFrame, channels, width: int, window: tuple[int, int]) -> np.ndarray:
    """(latency, predictor, channel) of one request whose clean epochs are ``epochs`` (event_id, recspan_id, at, x)."""
    n = epochs.count()
    if not n:
        raise ValueError("no clean epoch")
    if n < width:
        raise ValueError("fewer epochs than predictors")
    r = triangle(epochs, width)
    s = np.linalg.svd(r, compute_uv=False)
    if len(s) < width or s[-1] == 0 or s[0] / s[-1] > MAX_CONDITION:
        raise ValueError("the predictors are collinear")
    at = epochs.select("recspan_id", "at", "x", F.explode(F.sequence(F.lit(window[0]).cast("long"), F.lit(window[1] - 1).cast("long"))).alias("latency_tick")).withColumn("tick", F.col("at") + F.col("latency_tick"))
    cells = at.join(signal, ["recspan_id", "tick"])
    sums = [F.sum(F.col("x")[i] * F.col(c)).alias(f"s_{i}_{j}") for i in range(width) for j, c in enumerate(channels)]
    rows = {row["latency_tick"]: row for row in cells.groupBy("latency_tick").agg(*sums).collect()}
    out = np.zeros((window[1] - window[0], width, len(channels)))
    for k in range(window[1] - window[0]):
        row = rows[window[0] + k]
        b = np.array([[row[f"s_{i}_{j}"] for j in range(len(channels))] for i in range(width)], float)
        out[k] = np.linalg.solve(r, np.linalg.solve(r.T, b))
    return out


def expanded_design(epochs: DataFrame, pieces: DataFrame, offsets, overlap_correction: bool) -> DataFrame:
    """(row key, recspan_id, tick, cols) of the clean ticks: cols are (column, value) of all epochs at the tick."""
    clean = pieces.where("size(artifacts) = 0").select("recspan_id", "lo", "hi", F.explode("epochs").alias("epoch_id"))
    rows = clean.join(epochs.select("epoch_id", "request", "at", "x"), "epoch_id")
    rows = rows.withColumn("tick", F.explode(F.expr("sequence(lo, hi - 1)")))
    base = F.element_at(F.array(*(F.lit(o) for o, _, _ in offsets)), F.col("request") + 1)
    length = F.element_at(F.array(*(F.lit(n) for _, n, _ in offsets)), F.col("request") + 1)
    first = F.element_at(F.array(*(F.lit(s) for _, _, s in offsets)), F.col("request") + 1)
    cells = rows.select("epoch_id", "recspan_id", "tick", F.posexplode("x").alias("i", "value"), (base + 0).alias("base"), length.alias("length"), (F.col("tick") - F.col("at") - first).alias("latency"))
    cells = cells.where("value <> 0").withColumn("col", F.expr("cast(base + i * length + latency AS int)"))
    key = ["recspan_id", "tick"] + ([] if overlap_correction else ["epoch_id"])
    own = cells.groupBy(*key, "col").agg(F.sum("value").alias("value"))
    return own.groupBy(*key).agg(F.collect_list(F.struct("col", "value")).alias("cols"))


def normal_equations(design: DataFrame, signal: DataFrame, channels) -> tuple[DataFrame, DataFrame]:
    """X'X as (a, b, v), a <= b, and X'Y as (a, channels)."""
    pair = design.select(F.explode(F.expr("flatten(transform(cols, p -> transform(filter(cols, q -> q.col >= p.col), q -> struct(p.col AS a, q.col AS b, p.value * q.value AS v))))")).alias("e")).select("e.*")
    xy = design.join(signal, ["recspan_id", "tick"]).select(F.explode("cols").alias("p"), *channels)
    return pair.groupBy("a", "b").agg(F.sum("v").alias("v")), xy.groupBy(F.col("p.col").alias("a")).agg(*(F.sum(F.col("p.value") * F.col(c)).alias(c) for c in channels))


def fit_continuous(design: DataFrame, signal: DataFrame, channels, width: int) -> np.ndarray:
    """(column, channel). At most ``MAX_COLUMNS`` columns."""
    if width > MAX_COLUMNS:
        raise ValueError(f"{width} columns, more than {MAX_COLUMNS}")
    n = design.count()
    if n < width:
        raise ValueError("fewer clean ticks than columns")
    xx, xy = normal_equations(design, signal, channels)
    a, b = np.zeros((width, width)), np.zeros((width, len(channels)))
    for row in xx.collect():
        a[row.a, row.b] = a[row.b, row.a] = row.v
    for row in xy.collect():
        b[row.a] = [row[c] for c in channels]
    if not np.isfinite(c := np.linalg.cond(a)) or c > MAX_CONDITION:
        raise ValueError("the columns are collinear, or a latency has no clean data")
    return np.linalg.solve(a, b)


def multi_rerp(t: Timeline, signal: DataFrame, fmt: DataFormat, requests: list[Request], artifact_query="has _ARTIFACT_TYPE", artifact_type_field="_ARTIFACT_TYPE", overlap_correction: bool = True, regression_strategy: str = "auto", registered=None) -> list[Fit]:
    """All requests, fitted jointly."""
    if not requests:
        return []
    if len({r.name for r in requests}) != len(requests):
        raise ValueError("requests need different names")
    channels = list(fmt.channel_names)
    epochs, designs, windows = epoch_spans(t, fmt, requests, registered)
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.cache())
        return df

    try:
        return _fit(t, signal, fmt, requests, channels, hold(epochs), designs, windows, artifact_spans(t, artifact_query, artifact_type_field), overlap_correction, regression_strategy, hold)
    finally:
        for df in held:
            df.unpersist()


def _fit(t, signal, fmt, requests, channels, epochs, designs, windows, artifacts, overlap_correction, strategy, hold) -> list[Fit]:
    if any(r.all_or_nothing for r in requests):
        epochs = hold(tag_all_or_nothing(epochs, all_or_nothing(epochs, artifacts, overlap_correction)))
    pieces = hold(subspans(epochs, artifacts, overlap_correction))
    ids = epochs.select("epoch_id", "request")
    stats: dict = {}
    for name, df in (("points", accounting.point_stats(pieces, ids)), ("epochs", accounting.epoch_stats(pieces, ids))):
        for row in df.collect():
            stats.setdefault(row.request, {})[name] = {k: v for k, v in row.asDict().items() if k != "request"}
    for row in accounting.artifact_stats(pieces, ids).collect():
        stats[row.request].setdefault("artifacts", {})[row.artifact] = {"affected": row.affected, "unique": row["unique"]}
    how = accounting.choose_strategy(strategy, stats[None]["points"], stats[None]["epochs"])
    if how == "by-epoch":
        rejected = pieces.where("size(artifacts) > 0").select(F.explode("epochs").alias("epoch_id")).distinct()
        clean = hold(epochs.join(rejected, "epoch_id", "left_anti"))
        betas = [fit_by_epoch(clean.where(F.col("request") == i), signal, channels, len(d.names), w) for i, (d, w) in enumerate(zip(designs, windows, strict=True))]
    else:
        offsets, at = [], 0
        for d, (a, b) in zip(designs, windows, strict=True):
            offsets.append((at, b - a, a))
            at += len(d.names) * (b - a)
        flat = fit_continuous(expanded_design(epochs, pieces, offsets, overlap_correction), signal, channels, at)
        betas = [flat[o : o + len(d.names) * n].reshape(len(d.names), n, len(channels)).transpose(1, 0, 2) for (o, n, _), d in zip(offsets, designs, strict=True)]
    out = []
    for i, (r, d, b, (a, _)) in enumerate(zip(requests, designs, betas, windows, strict=True)):
        rows = [(r.name, p, name, a + k, float(fmt.ticks_to_ms(a + k)), *map(float, b[k, p])) for p, name in enumerate(d.names) for k in range(b.shape[0])]
        kind = "request string, predictor_idx int, predictor string, latency_tick bigint, latency_ms double, " + ", ".join(f"`{c}` double" for c in channels)
        out.append(Fit(r, t.events.sparkSession.createDataFrame(rows, kind), d, stats[None], stats.get(i, {}), how, overlap_correction, t))
    return out
