import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoked.functions.attrs import EventsError
from evoked.functions.data_format import DataFormat
from evoked.operators import artifact, intervals
from evoked.operators.accounting import choose_strategy, overlap_ratio, report
from evoked.operators.regression import Request, multi_rerp
from evoked.operators.timeline import Timeline
from evoked.plans.query import lex
from evoked.sources import erpss


RECORDINGS = [(60, {"lab": "north"}), (90, {"lab": "south", "retake": True})]
ROWS = [
    (0, 3, 9, {"word": "plum", "freq": 12, "rt": 312.5, "ok": True, "note": None}),
    (0, 7, 8, {"word": "fig", "freq": 2, "rt": 2.0, "ok": False, "note": "late"}),
    (1, 4, 40, {"word": "quince", "freq": -7, "rt": -7.25, "ok": True}),
    (1, 55, 58, {"word": None, "freq": 12, "note": "late", "block": 3}),
]


@pytest.fixture(scope="module")
def typed(spark):
    return Timeline.from_rows(spark, RECORDINGS, ROWS)


def columns_timeline(spark):
    """The same events with a column for each attribute."""
    out = []
    for i, (r, a, b, attrs) in enumerate(ROWS):
        out.append((i, r, a, b, *(x for k in KINDS for x in (attrs.get(k), k in attrs))))
    kinds = ", ".join(f"{k} {t}, {k}__present boolean" for k, t in KINDS.items())
    events = spark.createDataFrame(out, f"event_id long, recspan_id long, start_tick long, stop_tick long, {kinds}")
    spans = spark.createDataFrame([(0, 60, "north", None, False), (1, 90, "south", True, True)], "recspan_id long, ticks long, lab string, retake boolean, retake__present boolean")
    return Timeline.from_columns(events, spans, list(KINDS), ["lab", "retake"])


KINDS = {"word": "string", "freq": "long", "rt": "double", "ok": "boolean", "note": "string", "block": "long"}


def starts(t, q):
    return sorted(r.start_tick for r in t.find(q).collect())


def test_queries_against_plain_python(spark, typed):
    """Comparisons with null are those of null-safe equality for == and !=, and unknown otherwise; keys asked for must be there."""
    compare = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b}
    compare |= {op: (lambda a, b, f=f: a is not None and b is not None and f(a, b)) for op, f in (("<", lambda a, b: a < b), (">", lambda a, b: a > b), ("<=", lambda a, b: a <= b), (">=", lambda a, b: a >= b))}
    values = {"word": ["'fig'", "'g'"], "freq": ["2", "12", "3.5"], "rt": ["2", "-1e1"], "ok": ["true"], "note": ["'late'", "none"], "block": ["3"]}
    plain = {"none": None, "true": True}
    both = (typed, columns_timeline(spark))
    for key, literals in values.items():
        for op, f in compare.items():
            for text in literals:
                value = plain.get(text, text[1:-1] if text[0] == "'" else None)
                value = float(text) if value is None and text not in plain else value
                if value is None and op not in ("==", "!="):
                    continue
                want = sorted(a for _, a, _, attrs in ROWS if key in attrs and f(attrs[key], value))
                query = f"{key} {op} {text}"
                for t in both if op in ("==", "<") else (typed,):
                    assert starts(t, query) == want, query
    p = typed.placeholder()
    for query, want in [
        (p["freq"] < p["rt"], [3]), (p["missing"] == None, []), (~p["missing"].exists(), [3, 4, 7, 55]), ("has block or has ok", [3, 4, 7, 55]),  # noqa: E711
        (p.overlaps(1, 39, 56), [4, 55]), (p.overlaps(1, 40, 55), []), (p.overlaps(0, 8, 8), []), (p.recspan_info["lab"] == "north", [3, 7]),
        ("has _RECSPAN_INFO.retake and not (freq > 0)", [4]), ({"freq": 12, "_STOP_TICK": 58}, [55]), (None, [3, 4, 7, 55]), (False, []),
        ("freq == 2 or freq == 12 and _START_TICK > 5", [7, 55]), ("`_START_TICK` == 3", []), ("note == NONE", [3]),
    ]:
        assert starts(typed, query) == want, query


def test_bad_queries(typed):
    p = typed.placeholder()
    for bad in ("has 'freq'", "freq == 'many'", "'no end", r"word == '\t'", "lab.freq == 2", "_RECSPAN_INFO == 2", "freq", "(freq == 2", "freq == 2 and"):
        with pytest.raises(EventsError):
            typed.find(bad)
    with pytest.raises(TypeError):
        bool(p["freq"] == 2)
    with pytest.raises(EventsError):
        p["freq"] & (p["freq"] == 2)
    with pytest.raises(ValueError):
        typed.query(8)
    assert [lex(f"a < {x}")[-1] for x in ("2.5E3", "-.5", "+7")] == [("value", 2500.0), ("value", -0.5), ("value", 7)]


@pytest.mark.parametrize("encoding", ["map", "columns"])
def test_changes(spark, typed, encoding, tmp_path):
    t = typed if encoding == "map" else columns_timeline(spark)
    assert starts(t.move(100, "freq == 12"), None) == [4, 7, 103, 155]
    marked = t.set_attr("hand", "left", "ok == true")
    assert starts(marked, "hand == 'left'") == [3, 4] and starts(marked.delete_attr("hand", "has hand"), "has hand") == []
    assert starts(t.set_attr("note", None, "ok == true"), "note == none") == [3, 4]
    assert starts(t.update({"ok": False, "extra": 1}, "ok == true"), "ok == false and extra == 1") == [3, 4]
    assert starts(t.delete("freq == 12"), None) == [4, 7]
    with pytest.raises(Exception, match="no attribute block"):
        t.delete_attr("block").events.collect()
    with pytest.raises(TypeError):
        t.set_attr("freq", "many")
    for other in (t, marked, typed, columns_timeline(spark)):
        union = t.union(other)
        assert sorted(r.recspan_id for r in union.find(None).collect()) == [0, 0, 1, 1, 2, 2, 3, 3]
        assert starts(union, "freq == 12 and _RECSPAN_INFO.lab == 'south'") == [55, 55]
    assert starts(t.union(marked), "has hand") == [3, 4]
    # Merges: by attribute and by index, nulls equal each other, clashes change nothing.
    names = spark.createDataFrame([("plum", 1.5), ("fig", 0.5), (None, 9.0)], "word string, size double")
    assert starts(t.merge_df(names, "word"), "size > 1") == [3, 55]
    assert starts(t.merge_df(names, "word", "ok == true"), "has size") == [3]
    assert starts(t.merge_df(spark.createDataFrame([(1, True)], "r long, second boolean"), {"r": "_RECSPAN_ID"}), "second == true") == [4, 55]
    assert starts(t.merge_df(spark.createDataFrame([("fig", "late")], "word string, note string"), "word"), "note == 'late'") == [7, 55]
    for lookup in (spark.createDataFrame([("fig", "early")], "word string, note string"), names.union(names)):
        with pytest.raises(ValueError):
            t.merge_df(lookup, "word")
    with pytest.raises(TypeError):
        t.merge_df(spark.createDataFrame([("fig", "x")], "word string, freq string"), "word")
    # New events get ids without gaps; a saved timeline is the same one.
    more = marked.add_event(1, 70, 71, {"word": "date", "fresh": True}).add_recspan(10, {"lab": "east"})
    more.save(str(tmp_path / "t"))
    again = Timeline.load(spark, str(tmp_path / "t"))
    assert type(again.attrs) is type(t.attrs) and sorted(r.event_id for r in again.events.collect()) == [0, 1, 2, 3, 4]
    for query in ("hand == 'left'", "has fresh", "freq < 12 or has block", "note == none", "_RECSPAN_INFO.lab == 'south'"):
        assert starts(again, query) == starts(more, query), query
    assert [r.recspan_id for r in again.sorted_recspans().collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="no such recording"):
        t.add_event(8, 1, 2, {}).events.collect()


def test_single_events(spark, typed):
    for t in (typed, columns_timeline(spark)):
        assert t.event(1) == {"word": "fig", "freq": 2, "rt": 2.0, "ok": False, "note": "late"} and t.event(3)["word"] is None
        assert "ok" not in t.event(3) and t.exists(3) and not t.delete("has block").exists(3)
        with pytest.raises(KeyError):
            t.event(9)
        assert sorted((r.key, r.value) for r in t.items("has block").collect()) == [("block", "3"), ("freq", "12"), ("note", "late"), ("word", None)]


def test_relative(spark):
    t = Timeline.from_rows(spark, [(100, {}), (100, {})], [(0, 20, 21, {"x": 1}), (0, 10, 11, {}), (0, 30, 31, {}), (0, 40, 41, {"x": 1}), (1, 40, 41, {})])
    nth = lambda n, q=None: {r.event_id: r.other_id for r in t.relative(n, q).collect()}
    assert nth(1) == {0: 2, 1: 0, 2: 3, 3: None, 4: None}
    assert nth(-1) == {0: 1, 1: None, 2: 0, 3: 2, 4: None}
    assert nth(2, "has x")[1] == 3 and nth(1, "has x")[1] == 0
    with pytest.raises(IndexError):
        t.relative(0)


def _epochs(spark, rows):
    return spark.createDataFrame([(i, 0, a, b, f, x) for i, (a, b, f, x) in enumerate(rows)], "epoch_id long, recspan_id long, start long, stop long, flagged boolean, intrinsic array<string>")


def _artifacts(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], "recspan_id long, start long, stop long, artifact string")


def _random_spans(rng):
    ep = [(a, a + int(rng.integers(1, 25)), bool(rng.integers(2)), ["own"] if rng.random() < 0.2 else []) for a in map(int, rng.integers(-10, 80, 9))]
    art = [(a, a + int(rng.choice([1, 3, 30])), str(rng.choice(["x", "y"]))) for a in map(int, rng.integers(-10, 90, 4))]
    return ep, art


def _plain_sweep(ep, art, correct):
    low, high = min(e[0] for e in ep), max(e[1] for e in ep)
    edges = sorted({x for e in ep for x in e[:2]} | {min(max(x, low), high) for a in art for x in a[:2] if a[0] < high and a[1] > low})
    out = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        inside = [i for i, e in enumerate(ep) if e[0] <= lo < e[1]]
        names = {a[2] for a in art if a[0] <= lo < a[1]}
        for ids in ([inside] if correct and inside else [] if correct else [[i] for i in inside]):
            out.append((lo, hi, ids, sorted(names.union(*(ep[i][3] for i in ids)))))
    return sorted(out)


def test_sweep_against_plain_python(spark):
    rng = np.random.default_rng(11)
    for correct in (True, False):
        ep, art = _random_spans(rng)
        got = sorted((r.lo, r.hi, r.epochs, r.artifacts) for r in intervals.subspans(_epochs(spark, ep), _artifacts(spark, art), correct).collect())
        assert got == _plain_sweep(ep, art, correct)


def test_all_or_nothing_against_plain_python(spark):
    rng = np.random.default_rng(12)
    for correct in (True, False, True):
        ep, art = _random_spans(rng)
        pieces = _plain_sweep(ep, art, correct)
        nodes = {i for i, e in enumerate(ep) if e[2] and not e[3]}
        doomed = {i for _, _, ids, names in pieces if names for i in ids if i in nodes}
        while correct:
            more = {j for i in doomed for j in nodes - doomed if ep[i][0] < ep[j][1] and ep[j][0] < ep[i][1]}
            if not more:
                break
            doomed |= more
        assert {r.epoch_id for r in intervals.all_or_nothing(_epochs(spark, ep), _artifacts(spark, art), correct).collect()} == doomed


def test_overlapping_pairs_and_accounting(spark):
    rng = np.random.default_rng(13)
    rows = [(i, int(r), int(a), int(a + n)) for i, (r, a, n) in enumerate(zip(rng.integers(0, 2, 60), rng.integers(0, 200, 60), rng.choice([1, 4, 50], 60), strict=True))]
    df = spark.createDataFrame(rows, "event_id long, recspan_id long, start_tick long, stop_tick long")
    got = sorted((r.a_id, r.b_id) for r in intervals.overlapping_pairs(df.where("event_id % 2 = 0"), df.where("event_id % 2 = 1")).collect())
    assert got == sorted((x[0], y[0]) for x in rows[::2] for y in rows[1::2] if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    points = {f"{k}_{w}": n for k, n in (("ticks", 8), ("event_ticks", 12), ("no_overlap_ticks", 4)) for w in ("requested", "accepted")}
    text = report(points, {"requested": 4, "fully_accepted": 3, "partially_accepted": 0, "fully_rejected": 1}, {"blink": {"affected": 5, "unique": 2}})
    assert overlap_ratio(points) == 1.5 and "fully accepted: 3 of 4 (75.0%)" in text and "blink: 5 ticks, 2 by it alone" in text


def test_format():
    f = DataFormat(500, "uV", ("left", "right"))
    for ms in (0, 1, 2.9, 3.1, 700.4, -5):
        ticks = ms * 500 / 1000
        assert f.ms_to_ticks(ms, "down") == math.floor(ticks) and f.ms_to_ticks(ms, "up") == math.ceil(ticks)
        assert abs(f.ms_to_ticks(ms, "nearest") - ticks) <= 0.5
    # Windows take the ticks from the first to the last inside, which is one before the end.
    assert f.ms_span_to_ticks(-4, 6) == (-2, 4) and f.ms_span_to_ticks(-3.9, 5.9) == (-1, 3)
    assert f.compute_symbolic_transform("-left/4", exclude=["left"]) == [[1.0, 0.0], [-0.25, 1.0]]
    for bad in ("left + 2", "left * right", "middle"):
        with pytest.raises(ValueError):
            f.compute_symbolic_transform(bad)
    with pytest.raises(ValueError):
        DataFormat(500, "uV", ("left", "left"))


def _plain_flat(limit, x):
    ends = [next((j for j in range(i, len(x)) if max(x[i : j + 1]) - min(x[i : j + 1]) > limit), len(x)) for i in range(len(x))]
    return [e - i for i, e in enumerate(ends)]


def test_flat_runs(spark):
    rng = np.random.default_rng(14)
    for n in (0, 1, 2, 17, 64, 65):
        x = rng.integers(0, 9, n).tolist()
        assert artifact.flat_lengths(4, x).tolist() == _plain_flat(4, x)
    signal, want = [], []
    for r in range(3):
        x = [5] * 200 if r == 2 else np.repeat(rng.integers(0, 9, 60), 3).tolist()
        signal += [(r, i, float(v)) for i, v in enumerate(x)]
        want += [(r, i, n) for i, n in enumerate(_plain_flat(4, x))]
    df = spark.createDataFrame(signal, "recspan_id long, tick long, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, artifact.flat_spans(df, "v", 4.0).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = sorted(map(tuple, artifact.find_flat_spans(df, "v", 4.0, 6, pad=2).collect()))
    assert found == [(r, i - 2, i + n + 2) for r, i, n in want if n > 6]
    t = artifact.reject_flat(Timeline.from_rows(spark, [(180, {}), (180, {}), (200, {})], []), df, "v", 4.0, 50)
    assert [(r.recspan_id, r.start_tick, r.stop_tick) for r in t.sorted_events("_ARTIFACT_TYPE == 'flat'").collect()] == [(2, 0, 200)]


def test_overlap_closed_form(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=10)
    t = Timeline.from_rows(spark, [(10, {})], [(0, s, s + 1, {"type": k}) for s, k in ((0, "A"), (4, "A"), (5, "B"))])
    signal = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(y)], "recspan_id long, tick long, ch double")
    fmt = DataFormat(1000, "uV", ("ch",))
    a, b = multi_rerp(t, signal, fmt, [Request("type == 'A'", 0, 1, "1"), Request("type == 'B'", 0, 1, "1")])
    assert a.regression_strategy == "continuous"
    beta = lambda f: [r.ch for r in f.betas.orderBy("latency_tick").collect()]
    assert np.allclose(beta(a), [(y[0] + y[4]) / 2, y[1]]) and np.allclose(beta(b), [y[5] - y[1], y[6]])


def test_by_epoch_and_predict(spark):
    y = np.random.default_rng(1).normal(size=100)
    t = Timeline.from_rows(spark, [(100, {})], [(0, s, s + 1, {"type": k}) for s, k in ((10, "standard"), (20, "standard"), (30, "target"), (40, "target"), (50, "target"))] + [(0, 51, 53, {"_ARTIFACT_TYPE": "blink"})])
    signal = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(y)], "recspan_id long, tick long, ch double")
    fit = multi_rerp(t, signal, DataFormat(1000, "uV", ("ch",)), [Request("has type", 0, 2, "type", all_or_nothing=True)])[0]
    got = {(r.predictor, r.latency_tick): r.ch for r in fit.betas.collect()}
    assert fit.regression_strategy == "by-epoch" and fit.design.names == ("Intercept", "type[T.target]")
    for k in range(3):
        std, target = (y[10 + k] + y[20 + k]) / 2, (y[30 + k] + y[40 + k]) / 2
        assert np.isclose(got["Intercept", k], std) and np.isclose(got["type[T.target]", k], target - std)
    new = spark.createDataFrame([(0, "target")], "row_id long, type string")
    assert np.isclose({r.latency_tick: r.ch for r in fit.predict(new).collect()}[0], (y[30] + y[40]) / 2)
    with pytest.raises(ValueError):
        choose_strategy("by-epoch", {"event_ticks_accepted": 5, "ticks_accepted": 4}, {"partially_accepted": 0})


def test_binary_format(spark, tmp_path):
    rng = np.random.default_rng(2)
    samples = np.clip(np.cumsum(rng.integers(-40, 40, (512, 3)), 0), -2000, 2000)
    codes = np.zeros(512, int)
    codes[[5, 100, 255]] = [1, 7, intervals.PAUSE]
    names = ["Cz", "Pz", "Fz"]
    for compressed in (False, True):
        d = tmp_path / str(compressed)
        d.mkdir()
        (d / "x.raw").write_bytes(erpss.write_recording(samples, codes, names, 250, compressed))
        (d / "x.log").write_bytes(erpss.make_log(codes))
        ds = erpss.load(spark, str(d / "x.raw"), str(d / "x.log"), calibration_events=False)
        assert ds.data_format.channel_names == tuple(names) and len(ds) == 2
        got = ds.signal.orderBy("recspan_id", "tick").select(*names).collect()
        assert np.array_equal(np.array(got), samples)
        assert sorted((r.recspan_id, r.start_tick) for r in ds.events("code == 7").collect()) == [(0, 100)]
        # A loaded recording can be edited, merged and saved.
        more = ds.merge_df(spark.createDataFrame([(7, "odd")], "code int, kind string"), "code").timeline.set_attr("seen", True, "kind == 'odd'")
        more.save(str(d / "saved"))
        assert starts(Timeline.load(spark, str(d / "saved")), "seen == true and has kind") == [100]
        assert [r[:2] for r in erpss.read_log(erpss.make_log(codes))] == [(int(codes[i]), i) for i in np.flatnonzero(codes)]
    many = [f"{a}{b}" for a in "abcd" for b in range(10)]
    assert erpss.decode_names(erpss.encode_names(many), 40) == many


def test_streaming(spark, typed, tmp_path):
    from evoked.streaming.events import find

    typed.events.write.parquet(str(tmp_path / "in"))
    want = sum(starts(typed, "freq == 12"))
    stream = spark.readStream.schema(typed.events.schema).parquet(str(tmp_path / "in"))
    q = find(stream, typed, "freq == 12").writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("found").select(F.sum("start_tick")).first()[0] == want
