"""The registered queries over the driver's tables, with DuckDB SQL of the same rows.

The model: a user's events are a recording, a tick is an event's place in it, channels are value and k, and each event
spans [tick, tick + 1 + k % 4). Purchases have the attribute amount (null where k % 7 = 0); errors are artifacts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evoked.dataset import Dataset
from evoked.functions.data_format import DataFormat
from evoked.operators import accounting, artifact, epochs, intervals, regression
from evoked.operators.timeline import Timeline

FORMAT = DataFormat(250.0, "uV", ("v", "k"))

_TL = """tl AS (SELECT event_id, user_id AS recspan_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick,
 value AS v, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type FROM events),
ev AS (SELECT *, tick AS start_tick, tick + 1 + k % 4 AS stop_tick, event_type = 'purchase' AS has_amount,
 CASE WHEN event_type = 'purchase' AND k % 7 <> 0 THEN v END AS amount FROM tl),
rs AS (SELECT recspan_id, count(*) AS ticks, recspan_id % 2 = 0 AS even, max(recspan_id % 5) AS grp FROM tl GROUP BY recspan_id)"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value", "props")
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("event_id", F.col("user_id").alias("recspan_id"), place.cast("long").alias("tick"), F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type")


def timeline(spark: SparkSession, sf_dir: str) -> Timeline:
    b = base(spark, sf_dir)
    events = b.select(
        "event_id", "recspan_id", F.col("tick").alias("start_tick"), (F.col("tick") + 1 + F.col("k") % 4).alias("stop_tick"), "event_type", "v", "k",
        F.when((F.col("event_type") == "purchase") & (F.col("k") % 7 != 0), F.col("v")).alias("amount"), (F.col("event_type") == "purchase").alias("amount__present"),
    )
    users = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("recspan_id")).agg(F.count("*").alias("ticks"))
    spans = users.withColumn("even", F.col("recspan_id") % 2 == 0).withColumn("grp", F.col("recspan_id") % 5)
    return Timeline.from_columns(events, spans, ["event_type", "v", "k", "amount"], ["even", "grp"])


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("recspan_id", "tick", "v", F.col("k").cast("double").alias("k"))


_Q: dict[str, tuple[Callable, str | None]] = {}


def _query(sql: str | None = None, recursive: bool = False):
    def add(f):
        _Q[f.__name__] = (f, f"WITH {'RECURSIVE ' if recursive else ''}{_TL}{sql}" if sql else None)
        return f

    return add


def _filter(name: str, restrict, where: str) -> None:
    def run(spark, sf_dir):
        return timeline(spark, sf_dir).find(restrict).select("event_id", "recspan_id", "start_tick")

    _Q[name] = (run, f"WITH {_TL} SELECT event_id, ev.recspan_id, start_tick FROM ev JOIN rs USING (recspan_id) WHERE {where}")


_filter("q_filter_eq", "event_type == 'purchase'", "event_type = 'purchase'")
_filter("q_filter_and_or_flat", "event_type == 'click' or event_type == 'view' and k > 50", "(event_type = 'click' OR event_type = 'view') AND k > 50")
_filter("q_filter_not", "not (k >= 20)", "NOT k >= 20")
_filter("q_filter_has", "has amount", "has_amount")
_filter("q_filter_presence_rule", "k == 3 or amount > 50", "(k = 3 OR amount > 50) AND has_amount")
_filter("q_filter_missing_key", "nonexistent != 10", "false")
_filter("q_filter_null_safe", "amount == none", "amount IS NULL AND has_amount")
_filter("q_filter_not_equal", "amount != 12.5", "amount IS DISTINCT FROM 12.5 AND has_amount")
_filter("q_filter_recspan_attr", "_RECSPAN_INFO.even == true and _RECSPAN_INFO.grp < 3", "even AND grp < 3")
_filter("q_magic_fields", "_START_TICK >= 5 and _STOP_TICK < 20 and _RECSPAN_ID != 3", "start_tick >= 5 AND stop_tick < 20 AND ev.recspan_id <> 3")
_filter("q_dict_filter", {"event_type": "error", "_RECSPAN_ID": 7}, "event_type = 'error' AND ev.recspan_id = 7")


@_query(" SELECT count(*) AS n FROM ev WHERE event_type = 'view'")
def q_count(spark, sf_dir):
    return timeline(spark, sf_dir).find("event_type == 'view'").agg(F.count("*").alias("n"))


@_query(" SELECT event_id, k FROM ev WHERE recspan_id = 11 AND start_tick < 30 AND stop_tick > 10 AND event_type <> 'view'")
def q_overlap_at(spark, sf_dir):
    return timeline(spark, sf_dir).at(11, 10, 30, "event_type != 'view'").select("event_id", "k")


@_query(" SELECT a.event_id AS a_id, b.event_id AS b_id, a.recspan_id FROM ev a JOIN ev b ON a.recspan_id = b.recspan_id AND a.start_tick < b.stop_tick AND a.stop_tick > b.start_tick WHERE a.event_type = 'purchase' AND b.event_type = 'error'")
def q_overlap_pairs(spark, sf_dir):
    t = timeline(spark, sf_dir)
    return intervals.overlapping_pairs(t.find("event_type == 'purchase'"), t.find("event_type == 'error'"))


@_query(" SELECT event_id, lead(event_id, 2) OVER (PARTITION BY recspan_id ORDER BY start_tick) AS other_id FROM ev")
def q_relative_next(spark, sf_dir):
    return timeline(spark, sf_dir).relative(2)


@_query(" SELECT event_id, (SELECT max_by(o.event_id, o.start_tick) FROM ev o WHERE o.recspan_id = ev.recspan_id AND o.start_tick < ev.start_tick AND o.event_type = 'error') AS other_id FROM ev")
def q_relative_prev_restricted(spark, sf_dir):
    return timeline(spark, sf_dir).relative(-1, "event_type == 'error'")


@_query(" SELECT event_id, start_tick + CASE WHEN k > 50 THEN 100 ELSE 0 END AS start_tick, stop_tick + CASE WHEN k > 50 THEN 100 ELSE 0 END AS stop_tick FROM ev")
def q_move(spark, sf_dir):
    return timeline(spark, sf_dir).move(100, "k > 50").events.select("event_id", "start_tick", "stop_tick")


@_query(" SELECT event_id FROM ev WHERE event_type <> 'error'")
def q_delete(spark, sf_dir):
    return timeline(spark, sf_dir).delete("event_type == 'error'").events.select("event_id")


@_query(", t AS (SELECT max(recspan_id) + 1 AS r, max(event_id) + 1 AS e FROM ev) SELECT event_id, recspan_id FROM ev UNION ALL SELECT event_id + e, recspan_id + CASE WHEN true THEN (SELECT max(recspan_id) + 1 FROM rs) END FROM ev, t WHERE event_type = 'signup'")
def q_union_offset(spark, sf_dir):
    t = timeline(spark, sf_dir)
    other = Timeline(t.find("event_type == 'signup'"), t.recspans, t.attrs, t.recspan_attrs)
    return t.union(other).events.select("event_id", "recspan_id")


@_query(" SELECT recspan_id, tick, round(0.5 * v + 2 * k, 6) AS v, round(v - k, 6) AS k FROM tl")
def q_transform_linear(spark, sf_dir):
    out = epochs.transform(signal(spark, sf_dir), ["v", "k"], [[0.5, 2.0], [1.0, -1.0]])
    return out.select("recspan_id", "tick", F.round("v", 6).alias("v"), F.round("k", 6).alias("k"))


@_query(" SELECT recspan_id, tick, round(v - k / 2, 6) AS v, CAST(k AS DOUBLE) AS k FROM tl")
def q_transform_symbolic(spark, sf_dir):
    out = epochs.transform(signal(spark, sf_dir), ["v", "k"], FORMAT.compute_symbolic_transform("-k/2", exclude=["k"]))
    return out.select("recspan_id", "tick", F.round("v", 6).alias("v"), "k")


@_query(" SELECT event_id, CAST(round_even(v * 250 / 1000, 0) AS BIGINT) AS nearest, CAST(floor(v * 250 / 1000) AS BIGINT) AS down, CAST(ceil(v * 250 / 1000) AS BIGINT) AS up, CAST(tick AS DOUBLE) * 1000 / 250 AS ms FROM tl")
def q_ms_to_ticks(spark, sf_dir):
    v = F.col("v")
    return base(spark, sf_dir).select("event_id", *(FORMAT.ms_to_ticks(v, r).alias(r) for r in ("nearest", "down", "up")), FORMAT.ticks_to_ms(F.col("tick")).alias("ms"))


@_query(" SELECT recspan_id, tick, v, CAST(k AS DOUBLE) AS k FROM tl WHERE recspan_id = 5 AND tick >= 10 AND tick < 30")
def q_raw_slice(spark, sf_dir):
    return epochs.raw_slice(signal(spark, sf_dir), 5, 10, 30)


@_query(", c AS (SELECT recspan_id, tick, CASE event_type WHEN 'error' THEN 49152 WHEN 'signup' THEN 57344 ELSE 0 END AS code FROM tl), s AS (SELECT *, coalesce(sum(CAST(code > 0 AS INT)) OVER (PARTITION BY recspan_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS recspan FROM c) SELECT recspan_id, tick, CAST(recspan AS BIGINT) AS recspan, tick - min(tick) OVER (PARTITION BY recspan_id, recspan) AS recspan_tick FROM s")
def q_recspan_split(spark, sf_dir):
    code = F.when(F.col("event_type") == "error", intervals.PAUSE).when(F.col("event_type") == "signup", intervals.DELETE).otherwise(0)
    out = intervals.split_recspans(base(spark, sf_dir).select("recspan_id", "tick", code.alias("code")), by="recspan_id")
    return out.select("recspan_id", "tick", F.col("recspan").cast("long").alias("recspan"), "recspan_tick")


_EPOCHS = ", p AS (SELECT ev.event_id, ev.event_type, ev.recspan_id, start_tick FROM ev JOIN rs USING (recspan_id) WHERE {where} AND start_tick - 2 >= 0 AND start_tick + 4 <= ticks), l AS (SELECT unnest(range(-2, 4)) AS latency_tick), x AS (SELECT p.event_id, p.event_type, latency_tick, tl.v, tl.k FROM p CROSS JOIN l JOIN tl ON tl.recspan_id = p.recspan_id AND tl.tick = start_tick + latency_tick)"


def _cut(spark, sf_dir, restrict) -> DataFrame:
    t = timeline(spark, sf_dir)
    placed = t.with_recspans().where(t.predicate(restrict)[0]).where("start_tick - 2 >= 0 AND start_tick + 4 <= ticks")
    return epochs.epoch_rows(placed, signal(spark, sf_dir), -2, 4, extra=("event_type",))


@_query(_EPOCHS.format(where="event_type = 'purchase'") + ", n AS (SELECT event_id, row_number() OVER (ORDER BY recspan_id, start_tick, event_id) - 1 AS epoch_no FROM ev WHERE event_type = 'purchase') SELECT epoch_no, event_id, latency_tick, v, CAST(k AS DOUBLE) AS k FROM x JOIN n USING (event_id)")
def q_epochs_drop(spark, sf_dir):
    t = timeline(spark, sf_dir)
    out = epochs.epochs(t.find("event_type == 'purchase'"), signal(spark, sf_dir), t.recspans, -2, 4, "drop")
    return out.select("epoch_no", "event_id", "latency_tick", "v", "k")


@_query(_EPOCHS.format(where="event_type = 'purchase'") + " SELECT latency_tick, count(*) AS n, round(avg(v), 6) AS v, round(avg(k), 6) AS k FROM x GROUP BY latency_tick")
def q_erp_mean(spark, sf_dir):
    return _cut(spark, sf_dir, "event_type == 'purchase'").groupBy("latency_tick").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("v"), F.round(F.avg("k"), 6).alias("k"))


@_query(_EPOCHS.format(where="true") + " SELECT event_type, latency_tick, round(avg(v), 6) AS v FROM x GROUP BY event_type, latency_tick")
def q_erp_by_type(spark, sf_dir):
    return _cut(spark, sf_dir, None).groupBy("event_type", "latency_tick").agg(F.round(F.avg("v"), 6).alias("v"))


@_query(_EPOCHS.format(where="event_type IN ('click', 'view')") + " SELECT latency_tick, round(avg(v) FILTER (event_type = 'view') - avg(v) FILTER (event_type = 'click'), 6) AS v FROM x GROUP BY latency_tick")
def q_erp_diff(spark, sf_dir):
    mean = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("v")))
    return _cut(spark, sf_dir, "event_type == 'click' or event_type == 'view'").groupBy("latency_tick").agg(F.round(mean("view") - mean("click"), 6).alias("v"))


def _clean_fit(spark, sf_dir):
    """Purchases that are fully recorded, with value against k of the event, overlaps not corrected."""
    t, s = timeline(spark, sf_dir), signal(spark, sf_dir)
    return regression.multi_rerp(t, s, FORMAT, [regression.Request("event_type == 'purchase'", -8, 12, "k", all_or_nothing=True)], artifact_query=False, artifact_type_field=None, overlap_correction=False, regression_strategy="by-epoch")[0]


@_query(_EPOCHS.format(where="event_type = 'purchase'") + " SELECT latency_tick, round(regr_intercept(x.v, ev.k), 6) AS intercept, round(regr_slope(x.v, ev.k), 6) AS slope FROM x JOIN ev USING (event_id) GROUP BY latency_tick")
def q_rerp_continuous_predictor(spark, sf_dir):
    b = _clean_fit(spark, sf_dir).betas
    pick = lambda p: F.round(F.max(F.when(F.col("predictor") == p, F.col("v"))), 6)
    return b.groupBy("latency_tick").agg(pick("Intercept").alias("intercept"), pick("k").alias("slope"))


@_query(_EPOCHS.format(where="event_type = 'purchase'") + ", f AS (SELECT latency_tick, regr_intercept(x.v, ev.k) AS a, regr_slope(x.v, ev.k) AS b FROM x JOIN ev USING (event_id) GROUP BY latency_tick) SELECT row_id, latency_tick, round(a + b * row_id * 10, 5) AS v FROM f, (SELECT unnest(range(4)) AS row_id)")
def q_predict(spark, sf_dir):
    new = spark.range(4).select(F.col("id").alias("row_id"), (F.col("id") * 10.0).alias("k"))
    return _clean_fit(spark, sf_dir).predict_many(new).select("row_id", "latency_tick", F.round("v", 5).alias("v"))


def _spans(spark, sf_dir, flagged: bool = True) -> tuple[DataFrame, DataFrame]:
    t = timeline(spark, sf_dir)
    ep = t.find("event_type == 'purchase' or event_type == 'click'").select(
        F.col("event_id").alias("epoch_id"), "recspan_id", F.col("start_tick").alias("start"), F.col("stop_tick").alias("stop"), F.lit(flagged).alias("flagged"),
        F.when(F.col("k") % 10 == 0, F.array(F.lit("_BAD"))).otherwise(F.expr("cast(array() AS array<string>)")).alias("intrinsic"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("request"),
    )
    art = t.find("event_type == 'error'").select("recspan_id", F.col("start_tick").alias("start"), F.col("stop_tick").alias("stop"), F.lit("error").alias("artifact"))
    return ep, art


_SWEEP = """, ep AS (SELECT event_id, event_type, recspan_id, start_tick, stop_tick, k % 10 = 0 AS bad FROM ev WHERE event_type IN ('purchase', 'click')),
art AS (SELECT recspan_id, start_tick, stop_tick FROM ev WHERE event_type = 'error'),
bd AS (SELECT recspan_id, min(start_tick) AS a, max(stop_tick) AS b FROM ep GROUP BY recspan_id),
ed AS (SELECT recspan_id, start_tick AS lo FROM ep UNION SELECT recspan_id, stop_tick FROM ep UNION SELECT recspan_id, greatest(start_tick, a) FROM art JOIN bd USING (recspan_id) WHERE start_tick < b AND stop_tick > a
       UNION SELECT recspan_id, least(stop_tick, b) FROM art JOIN bd USING (recspan_id) WHERE start_tick < b AND stop_tick > a),
gp AS (SELECT recspan_id, lo, lead(lo) OVER (PARTITION BY recspan_id ORDER BY lo) AS hi FROM ed),
one AS (SELECT gp.recspan_id, lo, hi, event_id, event_type, bad, EXISTS (SELECT 1 FROM art WHERE art.recspan_id = gp.recspan_id AND art.start_tick <= lo AND art.stop_tick >= hi) AS err
        FROM gp JOIN ep ON ep.recspan_id = gp.recspan_id AND ep.start_tick <= lo AND ep.stop_tick >= hi WHERE hi IS NOT NULL),
pc AS (SELECT recspan_id, lo, hi, count(*) AS n, bool_or(bad) AS bad, any_value(err) AS err, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS epochs FROM one GROUP BY recspan_id, lo, hi)"""


@_query(_SWEEP + " SELECT recspan_id, lo, hi, epochs, concat_ws(',', CASE WHEN bad THEN '_BAD' END, CASE WHEN err THEN 'error' END) AS artifacts FROM pc")
def q_subspans(spark, sf_dir):
    return intervals.subspans(*_spans(spark, sf_dir)).select("recspan_id", "lo", "hi", F.array_join("epochs", ",").alias("epochs"), F.array_join("artifacts", ",").alias("artifacts"))


@_query(_SWEEP + " SELECT recspan_id, lo, hi, CAST(event_id AS VARCHAR) AS epochs, concat_ws(',', CASE WHEN bad THEN '_BAD' END, CASE WHEN err THEN 'error' END) AS artifacts FROM one")
def q_subspans_no_overlap(spark, sf_dir):
    return intervals.subspans(*_spans(spark, sf_dir), overlap_correction=False).select("recspan_id", "lo", "hi", F.array_join("epochs", ",").alias("epochs"), F.array_join("artifacts", ",").alias("artifacts"))


@_query(_SWEEP + """, ns AS (SELECT * FROM ep WHERE NOT bad),
mk AS (SELECT *, coalesce(CAST(start_tick >= max(stop_tick) OVER (PARTITION BY recspan_id ORDER BY start_tick, stop_tick, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INT), 1) AS nw FROM ns),
il AS (SELECT *, sum(nw) OVER (PARTITION BY recspan_id ORDER BY start_tick, stop_tick, event_id) AS isl FROM mk),
sd AS (SELECT DISTINCT one.event_id FROM one JOIN pc USING (recspan_id, lo, hi) WHERE pc.bad OR pc.err),
dm AS (SELECT DISTINCT recspan_id, isl FROM il JOIN sd USING (event_id)) SELECT event_id AS epoch_id FROM il JOIN dm USING (recspan_id, isl)""")
def q_all_or_nothing(spark, sf_dir):
    return intervals.all_or_nothing(*_spans(spark, sf_dir))


_BUCKET = _SWEEP + ", bk AS (SELECT recspan_id, lo, hi, hi - lo AS t, NULL AS request, n, n AS n_all, bad, err FROM pc UNION ALL SELECT o.recspan_id, o.lo, o.hi, o.hi - o.lo, CAST(o.event_type = 'click' AS INT), count(*), any_value(pc.n), any_value(pc.bad), any_value(pc.err) FROM one o JOIN pc USING (recspan_id, lo, hi) GROUP BY 1, 2, 3, 4, 5)"


def _accounting(f, spark, sf_dir):
    ep, art = _spans(spark, sf_dir)
    return f(intervals.subspans(ep, art), ep.select("epoch_id", "request"))


@_query(_BUCKET + " SELECT CAST(request AS INT) AS request, CAST(sum(t) AS BIGINT) AS ticks_requested, CAST(sum(t * n) AS BIGINT) AS event_ticks_requested, CAST(sum(CASE WHEN n_all = 1 THEN t ELSE 0 END) AS BIGINT) AS no_overlap_ticks_requested, CAST(sum(CASE WHEN bad OR err THEN 0 ELSE t END) AS BIGINT) AS ticks_accepted, CAST(sum(CASE WHEN bad OR err THEN 0 ELSE t * n END) AS BIGINT) AS event_ticks_accepted, CAST(sum(CASE WHEN NOT (bad OR err) AND n_all = 1 THEN t ELSE 0 END) AS BIGINT) AS no_overlap_ticks_accepted FROM bk GROUP BY request")
def q_accounting_ticks(spark, sf_dir):
    return _accounting(accounting.point_stats, spark, sf_dir)


@_query(_BUCKET + " SELECT CAST(request AS INT) AS request, a AS artifact, CAST(sum(t) AS BIGINT) AS affected, CAST(sum(CASE WHEN bad AND err THEN 0 ELSE t END) AS BIGINT) AS \"unique\" FROM bk, (VALUES ('_BAD'), ('error')) v(a) WHERE CASE a WHEN '_BAD' THEN bad ELSE err END GROUP BY request, a")
def q_accounting_artifacts(spark, sf_dir):
    return _accounting(accounting.artifact_stats, spark, sf_dir)


@_query(_SWEEP + ", s AS (SELECT o.event_id, CAST(any_value(o.event_type) = 'click' AS INT) AS r, bool_and(NOT (pc.bad OR pc.err)) AS ev, bool_or(NOT (pc.bad OR pc.err)) AS so FROM one o JOIN pc USING (recspan_id, lo, hi) GROUP BY o.event_id), u AS (SELECT * FROM s UNION ALL SELECT event_id, NULL, ev, so FROM s) SELECT CAST(r AS INT) AS request, count(*) AS requested, count(*) FILTER (ev) AS fully_accepted, count(*) FILTER (so AND NOT ev) AS partially_accepted, count(*) FILTER (NOT so) AS fully_rejected FROM u GROUP BY r")
def q_epoch_status(spark, sf_dir):
    return _accounting(accounting.epoch_stats, spark, sf_dir)


def _design(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t, s = timeline(spark, sf_dir), signal(spark, sf_dir)
    ep, designs, _ = regression.epoch_spans(t, FORMAT, [regression.Request("event_type == 'purchase'", 0, 8, "k")])
    pieces = intervals.subspans(ep, regression.artifact_spans(t, "event_type == 'error'", None))
    return regression.expanded_design(ep, pieces, [(0, 3, 0)], True), s


_XX = """, ep AS (SELECT ev.*, 1.0 AS x0, CAST(k AS DOUBLE) AS x1 FROM ev WHERE event_type = 'purchase'),
bad AS (SELECT DISTINCT recspan_id, t AS tick FROM (SELECT recspan_id, unnest(range(start_tick, stop_tick)) AS t FROM ev WHERE event_type = 'error')),
ds AS (SELECT recspan_id, start_tick + l AS tick, i * 3 + l AS col, sum(CASE i WHEN 0 THEN x0 ELSE x1 END) AS value FROM ep, (SELECT unnest(range(3)) AS l), (SELECT unnest(range(2)) AS i) GROUP BY 1, 2, 3),
cl AS (SELECT ds.* FROM ds JOIN rs USING (recspan_id) WHERE tick < ticks AND value <> 0 AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.recspan_id = ds.recspan_id AND bad.tick = ds.tick))"""


@_query(_XX + " SELECT CAST(p.col AS INT) AS a, CAST(q.col AS INT) AS b, sum(p.value * q.value) AS v FROM cl p JOIN cl q ON p.recspan_id = q.recspan_id AND p.tick = q.tick AND p.col <= q.col GROUP BY 1, 2")
def q_normal_equations(spark, sf_dir):
    return regression.normal_equations(*_design(spark, sf_dir), ["v"])[0]


@_query(_XX + " SELECT CAST(col AS INT) AS a, round(sum(value * v), 4) AS v FROM cl JOIN tl USING (recspan_id, tick) GROUP BY 1")
def q_normal_equations_xy(spark, sf_dir):
    return regression.normal_equations(*_design(spark, sf_dir), ["v"])[1].select("a", F.round("v", 4).alias("v"))


#: The columns of clicks and purchases: intercept and purchase at three latencies; then X'X with both channels' X'Y beside it,
#: reduced row by row.
_SOLVE = (
    _XX.replace("1.0 AS x0, CAST(k AS DOUBLE) AS x1 FROM ev WHERE event_type = 'purchase'", "1.0 AS x0, CAST(event_type = 'purchase' AS DOUBLE) AS x1 FROM ev WHERE event_type IN ('purchase', 'click')")
    + """, cols AS (SELECT unnest(range(6)) AS c),
xx AS (SELECT p.col AS a, q.col AS b, sum(p.value * q.value) AS v FROM cl p JOIN cl q ON p.recspan_id = q.recspan_id AND p.tick = q.tick GROUP BY 1, 2),
xy AS (SELECT col AS a, sum(value * v) AS v, sum(value * k) AS k FROM cl JOIN tl USING (recspan_id, tick) GROUP BY 1),
rw AS (SELECT x.c AS a, list(coalesce(xx.v, 0.0) ORDER BY y.c) AS r FROM cols x CROSS JOIN cols y LEFT JOIN xx ON xx.a = x.c AND xx.b = y.c GROUP BY x.c),
gj AS (SELECT 0 AS n, list(list_concat(r, [v, k]) ORDER BY a) AS m FROM rw JOIN xy USING (a)
 UNION ALL SELECT n + 1, list_transform(m, lambda r, i: CASE WHEN i = n + 1 THEN list_transform(r, lambda x: x / m[n + 1][n + 1]) ELSE list_transform(r, lambda x, j: x - r[n + 1] * m[n + 1][j] / m[n + 1][n + 1]) END) FROM gj WHERE n < 6)
 SELECT CASE WHEN c < 3 THEN 'Intercept' ELSE 'event_type[T.purchase]' END AS predictor, c % 3 AS latency_tick, round(m[c + 1][7], 6) AS v, round(m[c + 1][8], 6) AS k FROM gj, cols WHERE n = 6"""
)


@_query(_SOLVE, recursive=True)
def q_rerp_overlap_corrected(spark, sf_dir):
    t, s = timeline(spark, sf_dir), signal(spark, sf_dir)
    fit = regression.multi_rerp(t, s, FORMAT, [regression.Request("event_type == 'purchase' or event_type == 'click'", 0, 8, "event_type", name="both")], artifact_query="event_type == 'error'", artifact_type_field=None)[0]
    return fit.betas.select("predictor", "latency_tick", F.round("v", 6).alias("v"), F.round("k", 6).alias("k"))


@_query(" SELECT event_id, CASE WHEN k > 50 THEN 1.5 END AS flag, amount FROM ev WHERE k > 50 OR has_amount")
def q_set_attr(spark, sf_dir):
    t = timeline(spark, sf_dir).set_attr("flag", 1.5, "k > 50")
    return t.find(t.placeholder().has_key("flag") | t.placeholder().has_key("amount")).select("event_id", "flag", "amount")


@_query(" SELECT event_id FROM ev WHERE has_amount AND NOT coalesce(amount > 50, false)")
def q_delete_attr(spark, sf_dir):
    return timeline(spark, sf_dir).delete_attr("amount", "amount > 50").find("has amount").select("event_id")


@_query(" SELECT event_id, CASE event_type WHEN 'click' THEN 1 ELSE 7 END AS weight, event_type = 'view' AS seen FROM ev WHERE event_type IN ('click', 'view') AND k < 60")
def q_merge_df(spark, sf_dir):
    lookup = spark.createDataFrame([("click", 1, False), ("view", 7, True), ("none", 9, True)], "event_type string, weight int, seen boolean")
    return timeline(spark, sf_dir).merge_df(lookup, "event_type", "k < 60").find("has weight").select("event_id", "weight", "seen")


@_query(" SELECT event_id, recspan_id % 10 AS ward FROM ev WHERE recspan_id < 40")
def q_merge_index(spark, sf_dir):
    lookup = spark.range(40).select(F.col("id").alias("user"), (F.col("id") % 10).alias("ward"))
    return timeline(spark, sf_dir).merge_df(lookup, {"user": "_RECSPAN_ID"}).find("has ward").select("event_id", "ward")


@_query(", t AS (SELECT max(event_id) + 1 AS e FROM ev) SELECT event_id + e AS event_id, 'new' AS mark, v FROM ev, t WHERE event_type = 'signup'")
def q_union_keys(spark, sf_dir):
    t = timeline(spark, sf_dir)
    marked = t.set_attr("mark", "new", "event_type == 'signup'")
    other = Timeline(marked.find("has mark"), t.recspans, marked.attrs, t.recspan_attrs)
    return t.union(other).find("mark == 'new'").select("event_id", "mark", "v")


@_query(", n AS (SELECT row_number() OVER (ORDER BY recspan_id, start_tick) - 1 AS no, * FROM ev WHERE event_type = 'error'), t AS (SELECT max(event_id) + 1 AS e FROM ev) SELECT no + e AS event_id, recspan_id, start_tick, stop_tick + 2 AS stop_tick, v FROM n, t")
def q_add_events(spark, sf_dir):
    t = timeline(spark, sf_dir)
    empty = F.lit(None)
    attrs = F.create_map(F.lit("v"), F.struct(empty.cast("bigint").alias("l"), F.col("v").alias("d"), empty.cast("string").alias("s"), empty.cast("boolean").alias("b")), F.lit("added"), F.struct(empty.cast("bigint").alias("l"), empty.cast("double").alias("d"), empty.cast("string").alias("s"), F.lit(True).alias("b")))
    new = t.find("event_type == 'error'").select("recspan_id", "start_tick", (F.col("stop_tick") + 2).alias("stop_tick"), attrs.alias("attrs"))
    return t.add_events(new, {"v": "numeric", "added": "bool"}).find("added == true").select("event_id", "recspan_id", "start_tick", "stop_tick", "v")


@_query(" SELECT event_id, k > 50 AND event_type = 'view' AS matches FROM ev")
def q_matches(spark, sf_dir):
    return timeline(spark, sf_dir).matches("k > 50 and event_type == 'view'").select("event_id", "matches")


@_query(" SELECT recspan_id, start_tick, event_id FROM ev WHERE event_type = 'error' ORDER BY 1, 2, 3")
def q_events_sorted(spark, sf_dir):
    return timeline(spark, sf_dir).sorted_events("event_type == 'error'").select("recspan_id", "start_tick", "event_id")


@_query(" SELECT recspan_id, ticks, even, grp FROM rs ORDER BY 1")
def q_recspans(spark, sf_dir):
    return timeline(spark, sf_dir).sorted_recspans().select("recspan_id", "ticks", "even", "grp")


@_query(" SELECT event_id, 'event_type' AS key, event_type AS value FROM ev WHERE k = 7 UNION ALL SELECT event_id, 'k', CAST(k AS VARCHAR) FROM ev WHERE k = 7 UNION ALL SELECT event_id, 'amount', NULL FROM ev WHERE k = 7 AND has_amount AND amount IS NULL UNION ALL SELECT event_id, 'grp', CAST(recspan_id % 5 AS VARCHAR) FROM ev WHERE k = 7 AND false")
def q_items(spark, sf_dir):
    return timeline(spark, sf_dir).items("k == 7").where("key <> 'v' AND (key <> 'amount' OR value IS NULL)")


@_query(" SELECT event_id, stop_tick - start_tick AS ticks, CASE WHEN stop_tick - start_tick = 1 THEN 1.0 ELSE pow(2.0, ceil(log2(stop_tick - start_tick)) - 1) END AS magnitude FROM ev")
def q_magnitude(spark, sf_dir):
    n = F.col("stop_tick") - F.col("start_tick")
    return timeline(spark, sf_dir).events.select("event_id", n.alias("ticks"), intervals.magnitude(n).alias("magnitude"))


@_query(" SELECT recspan_id, tick, round(max(v) OVER w - min(v) OVER w, 6) AS range FROM tl WINDOW w AS (PARTITION BY recspan_id ORDER BY tick ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def q_peak_to_peak(spark, sf_dir):
    return artifact.peak_to_peak(signal(spark, sf_dir), "v", 5).select("recspan_id", "tick", F.round("range", 6).alias("range"))


_FLAT = ", a AS (SELECT x.recspan_id, x.tick, (SELECT min(y.tick) FROM tl y WHERE y.recspan_id = x.recspan_id AND y.tick > x.tick AND (SELECT max(z.v) - min(z.v) FROM tl z WHERE z.recspan_id = x.recspan_id AND z.tick BETWEEN x.tick AND y.tick) > 40) AS e, max(x.tick) OVER (PARTITION BY x.recspan_id) AS m FROM tl x), f AS (SELECT recspan_id, tick, coalesce(e, m + 1) AS stop FROM a)"


@_query(_FLAT + " SELECT recspan_id, tick - 1 AS start, stop + 1 AS stop FROM f WHERE stop - tick > 2")
def q_find_flat_spans(spark, sf_dir):
    return artifact.find_flat_spans(signal(spark, sf_dir), "v", 40.0, 2, pad=1)


@_query(_FLAT + ", g AS (SELECT *, max(stop) OVER (PARTITION BY recspan_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM f) SELECT recspan_id, tick AS start_tick, stop AS stop_tick FROM g WHERE stop - tick > 3 AND (p IS NULL OR stop > p)")
def q_reject_flat(spark, sf_dir):
    t = artifact.reject_flat(timeline(spark, sf_dir), signal(spark, sf_dir), "v", 40.0, 3)
    return t.find("_ARTIFACT_TYPE == 'flat'").select("recspan_id", "start_tick", "stop_tick")


@_query(_EPOCHS.format(where="event_type IN ('click', 'purchase', 'view')") + " SELECT concat('event_type[', event_type, ']') AS predictor, latency_tick, round(avg(v), 6) AS v, round(avg(k), 6) AS k FROM x GROUP BY event_type, latency_tick")
def q_by_type_fit(spark, sf_dir):
    which = "event_type == 'click' or event_type == 'purchase' or event_type == 'view'"
    request = regression.Request(which, -8, 12, "0 + event_type", all_or_nothing=True)
    fit = regression.multi_rerp(timeline(spark, sf_dir), signal(spark, sf_dir), FORMAT, [request], artifact_query=False, artifact_type_field=None, overlap_correction=False, regression_strategy="by-epoch")[0]
    return fit.betas.select("predictor", "latency_tick", F.round("v", 6).alias("v"), F.round("k", 6).alias("k"))


@_query(" SELECT event_id, 1.0 AS \"Intercept\", CAST(event_type = 'purchase' AS DOUBLE) AS purchase, CAST(event_type = 'view' AS DOUBLE) AS \"view\", CAST(recspan_id % 5 AS DOUBLE) AS grp, CAST(k + 1 AS DOUBLE) AS k1 FROM ev WHERE event_type IN ('click', 'purchase', 'view')")
def q_design_categorical(spark, sf_dir):
    t = timeline(spark, sf_dir)
    which = "event_type == 'click' or event_type == 'purchase' or event_type == 'view'"
    rows, designs, _ = regression.epoch_spans(t, FORMAT, [regression.Request(which, 0, 8, "event_type + _RECSPAN_INFO.grp + I(k + 1)")])
    names = ["Intercept", "purchase", "view", "grp", "k1"]
    if len(designs[0].names) != len(names):
        raise ValueError(f"a column for each of {names} is expected, not {designs[0].names}")
    return rows.select("event_id", *(F.col("x")[i].alias(n) for i, n in enumerate(names)))


@_query(_BUCKET + " SELECT CAST(request AS INT) AS request, round(sum(CASE WHEN bad OR err THEN 0 ELSE t * n END) / sum(CASE WHEN bad OR err THEN 0 ELSE t END), 9) AS ratio FROM bk GROUP BY request")
def q_overlap_ratio(spark, sf_dir):
    return _accounting(accounting.point_stats, spark, sf_dir).select("request", F.round(F.col("event_ticks_accepted") / F.col("ticks_accepted"), 9).alias("ratio"))


@_query(_BUCKET + ", s AS (SELECT o.event_id, bool_and(NOT (pc.bad OR pc.err)) AS ev, bool_or(NOT (pc.bad OR pc.err)) AS so FROM one o JOIN pc USING (recspan_id, lo, hi) GROUP BY o.event_id) SELECT CASE WHEN (SELECT sum(t * n) > sum(t) FROM bk WHERE request IS NULL AND NOT (bad OR err)) OR (SELECT count(*) FILTER (so AND NOT ev) > 0 FROM s) THEN 'continuous' ELSE 'by-epoch' END AS strategy")
def q_strategy(spark, sf_dir):
    ep, art = _spans(spark, sf_dir)
    pieces, ids = intervals.subspans(ep, art), ep.select("epoch_id", "request")
    points, whole = (f(pieces, ids).where("request IS NULL").first().asDict() for f in (accounting.point_stats, accounting.epoch_stats))
    return spark.createDataFrame([(accounting.choose_strategy("auto", points, whole),)], "strategy string")


@_query(", p AS (SELECT ev.recspan_id, start_tick FROM ev JOIN rs USING (recspan_id) WHERE event_type = 'purchase'), c AS (SELECT d, avg(tl.v) AS v, avg(tl.k) AS k FROM (SELECT p.recspan_id, start_tick, c AS d, l, count(*) OVER (PARTITION BY p.recspan_id, start_tick, c) AS n FROM p JOIN rs USING (recspan_id), (VALUES (-1), (3)) q(c), (SELECT unnest(range(-1, 2)) AS l) WHERE start_tick + c + l >= 0 AND start_tick + c + l < ticks) z JOIN tl ON tl.recspan_id = z.recspan_id AND tl.tick = z.start_tick + d + l WHERE n = 3 GROUP BY d), s AS (SELECT max(v) FILTER (d = 3) - max(v) FILTER (d = -1) AS v, max(k) FILTER (d = 3) - max(k) FILTER (d = -1) AS k FROM c) SELECT recspan_id, tick, round(tl.v * 10 / s.v, 3) AS v, round(tl.k * 10 / s.k, 3) AS k FROM tl, s")
def q_calibrate(spark, sf_dir):
    t = timeline(spark, sf_dir).set_attr("calibration_pulse", True, "event_type == 'purchase'")
    ds = Dataset(FORMAT, signal(spark, sf_dir), t)
    out = ds.calibrated(calibrate_half_width_ticks=1, calibrate_low_cursor_time=-4, calibrate_high_cursor_time=12, calibrate_pulse_size=10)
    return out.signal.select("recspan_id", "tick", F.round("v", 3).alias("v"), F.round("k", 3).alias("k"))


@_query(" SELECT tl.event_id, s.span FROM tl JOIN (SELECT unnest(range(9)) AS span) s ON tl.tick >= span * 7 AND tl.tick < span * 7 + 7")
def q_locate_ticks(spark, sf_dir):
    spans = spark.range(9).select(F.col("id").alias("span"), (F.col("id") * 7).alias("start"), (F.col("id") * 7 + 7).alias("stop"))
    return intervals.locate_ticks(base(spark, sf_dir).select("event_id", "tick"), spans).select("event_id", "span")


@_query(_FLAT + " SELECT recspan_id, tick, stop - tick AS length FROM f")
def q_flat_spans(spark, sf_dir):
    return artifact.flat_spans(signal(spark, sf_dir), "v", 40.0)


def queries() -> dict[str, Callable]:
    return {k: f for k, (f, _) in _Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _Q.items() if s}
