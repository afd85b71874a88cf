import hashlib
import html
import random
import re

import pytest
from pyspark.sql import functions as F

from evoked.llm import adaptive_quality, bpe_automaton, chat_format, lang_fusion, line_dedup, page_diff, positional_index, simhash, toxic_crf, url_tree

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h1 string"
BASE = "the quick brown fox jumps over the lazy dog near the river bank while seven old men watch"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, BASE, "en", "s", 1, "x"), (2, BASE, "en", "s", 1, "x"), (2, BASE, "en", "s", 1, "x"), (3, None, None, None, None, None), (4, "", "en", "s", 0, ""), (None, BASE + "s", "en", None, 1, "x")]
    rows.append((5, f"{BASE}\nshort\n{BASE[:-1]}x\nanother line that nothing else is near to", "en", "s", 1, "x"))
    rows.append((6, ("word " * 60_000).strip(), "en", "s", 1, "x"))
    return spark.createDataFrame(rows, DOCS)


def test_chat_layouts(spark):
    same = [("user", "hi </turn> \\l"), ("assistant", "<turn x>\n")]
    import json

    layouts = [
        {"messages": [{"role": r, "content": t} for r, t in same]}, {"conversations": [{"from": {"user": "human", "assistant": "gpt"}[r], "value": t} for r, t in same]},
        {"prompt": same[0][1], "completion": same[1][1]}, {"instruction": same[0][1], "output": same[1][1]}, {"question": same[0][1], "answer": same[1][1]},
    ]
    rows = [(i, json.dumps(x)) for i, x in enumerate(layouts)] + [(90, "no json"), (91, None), (92, '{"strange": 1}'), (93, '{"prompt": null, "completion": "a"}')]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    out = chat_format.render(chat_format.canonical_turns(df)).select("conv_id", "formatted", "segments", chat_format.read_back(F.col("formatted")).alias("turns")).collect()
    got = {r.conv_id: r for r in out}
    assert set(got) == {0, 1, 2, 3, 4, 93}
    for i in range(5):
        assert [(t.role, t.text) for t in got[i].turns] == same
        for s, (role, text) in zip(got[i].segments, same, strict=True):
            assert got[i].formatted[s.start : s.end] == text.replace("\\", "\\e").replace("<turn", "\\lturn").replace("</turn", "\\l/turn") and s.loss == (role == "assistant")
    assert [t.text for t in got[93].turns] == ["", "a"]
    assert chat_format.unmapped(df).agg(F.sum("n")).first()[0] == 3
    assert chat_format.render(chat_format.canonical_turns(df.where("false"))).count() == 0


def test_pages(spark):
    page = "<html><head><title>t</title></head><body><div>Shared &amp; plain</div><nav><p>menu</p></nav>{}<div class='sidebar'>x</div><script>var a='<p>no</p>'</script><footer>f</footer></body>"
    rows = [(1, "http://h.org/a/1", page.format("<article><h1>A</h1><p>one\n two<br>three<p>four</article>")), (2, "http://h.org/a/2", page.format("<div>own words</div>"))]
    rows += [(3, "http://h.org/a/3", None), (4, None, "<p>alone"), (5, "", "<article>&lt;b&gt; <b>bold</b>")]
    got = {r.page_id: r.text for r in page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "A\n\none two three\n\nfour", 2: "own words", 3: "", 4: "alone", 5: "<b> bold"}
    assert html.unescape("&amp;") == "&"


def test_lcs_is_longest():
    rng = random.Random(0)
    for _ in range(300):
        a, b = [[rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        pairs = sorted(page_diff.aligned(a, b))
        assert len(pairs) == t[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = bpe_automaton.default_path()
    library, own = Tokenizer.from_file(path), bpe_automaton.Automaton(bpe_automaton.compile_merges(open(path, encoding="utf-8").read()))
    rng = random.Random(3)
    pools = ["ab \n'st", "  \t\n a1", "aAbBeEtThH 's", "0123456789²½٣a ", "日本語ab é́", "!!!==--  #", "\x1c\x1f\x85 a\u200b\xa0"]
    texts = ["", "<|endoftext|>x<|endoftext|>", "a" * 5000, " " * 3000, BASE] + ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60))) for _ in range(2000)]
    for t in texts:
        ids = own.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == t


def test_bpe_frame(spark, docs):
    path = bpe_automaton.default_path()
    rows = {r.doc_id: r for r in bpe_automaton.digests(docs, path).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (rows[3].n_tokens, rows[3].ids_sha256, rows[3].decoded_sha256) == (0, empty, empty)
    assert rows[6].decoded_sha256 == hashlib.sha256(("word " * 60_000).strip().encode()).hexdigest()
    back = bpe_automaton.decode(bpe_automaton.encode(docs.select("doc_id", "text"), path), path, out="again")
    assert back.where("coalesce(text, '') <> again").count() == 0


def test_urls(spark):
    urls = {1: "http://A.example.net/en/1?x", 2: "http://a.example.net/de/1", 3: "https://b.example.com/de/2#t", 4: "https://x.org/fr/1", 5: None, 6: "no scheme", 7: "http://net", 8: "http://z.com/a"}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_tree.judge(spark.createDataFrame(list(urls.items()), "page_id long, url string")).collect()}
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[2][2:] == ("net/", "block") and got[3][2:] == ("example.com/de/", "block")
    assert got[4][2:] == ("org/fr/", "allow") and got[5] == got[6] == ("", "", None, "allow") and got[7][2] is None and got[8][3] == "allow"


def test_language(spark):
    words = {"en": "the and of with from that this", "de": "der die und nicht eine auch mit", "fr": "le la les des une est pour"}
    rng, rows = random.Random(5), []
    for i in range(60):
        lang = ["en", "de", "fr"][i % 3]
        body = " ".join(rng.choice(words[lang].split()) for _ in range(30))
        rows.append((i, f"http://{lang}.x.org/{i}", f"<html lang={lang}><p>{body}</p>" if i % 5 else f"<p>{body}</p>"))
    rows += [(100, "http://de.x.org/", None), (101, None, "")]
    pages = lang_fusion.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r.lang for r in lang_fusion.identify(pages, lang_fusion.fit_text(pages)).collect()}
    assert all(got[i] == ["en", "de", "fr"][i % 3] for i in range(60)) and got[100] == "de" and got[101] in ("en", "de", "fr")


def test_simhash_groups(spark, docs):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    prints = [base]
    for _ in range(300):
        x = rng.choice(prints) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    fps = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(prints)], "node long, f long").dropDuplicates(["f"])
    nodes = {r.node: r.f & (1 << 64) - 1 for r in fps.collect()}
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and (nodes[a] ^ nodes[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in simhash.components(simhash.links(fps, 4)).collect()}
    assert {n: got.get(n, n) for n in nodes} == {n: find(n) for n in nodes}
    out = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in simhash.near_groups(docs).collect())
    assert len(out) == 8 and dict(out)[2] == 1 and dict(out)[3] == dict(out)[4] == 3


def test_line_dedup(spark, docs):
    rows = line_dedup.dedup_lines(docs).collect()
    got = {r.doc_id: r.text for r in rows}
    assert len(rows) == 8 and got[3] is None and got[4] == "" and got[2] == ""
    assert got[None] == BASE + "s" and got[1] == ""  # the null doc_id comes first, and BASE is one insertion from its line
    assert got[5] == "short\nanother line that nothing else is near to"  # its first line is equal to one of document 1, its third near one
    rng = random.Random(4)
    lines = []
    for _ in range(120):
        x = list("".join(rng.choice("abc ") for _ in range(rng.randrange(16, 90)))) if not lines or rng.random() < 0.4 else list(rng.choice(lines))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(x))
            x[k : k + rng.randrange(2)] = rng.choice(["", "z", "a"])
        lines.append("".join(x))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    near = lambda a, b: abs(len(a) - len(b)) <= 1 and _distance(a, b) <= 1
    want = {i for i, x in enumerate(lines) if len(x) >= 16 and any(len(y) >= 16 and near(x, y) for y in lines[:i])}
    assert {r.doc_id for r in line_dedup.dedup_lines(df).where("_n_dropped = 1").collect()} == want


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_toxicity(spark):
    rng, rows, labels = random.Random(6), [], []
    for i in range(400):
        words = [rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(30)]
        if i % 5 == 0:
            words[rng.randrange(30)] = rng.choice(["vilest", "rotten"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(900, None), (901, ""), (902, "you ROTTEN, alpha")]
    df, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(5000, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    field = toxic_crf.fit_field(df, y)
    out = {r.doc_id: r for r in toxic_crf.score(df, field).collect()}
    assert all((out[i].score >= 0.3) == (i % 5 == 0) for i in range(400))
    assert out[900].score == out[901].score < 0.3 and [(s.start, s.end) for s in out[902].toxic_spans] == [(4, 10)]
    assert toxic_crf.fit_field(df, y.where("toxic = 0")).score([b"rotten"]) == 0.0


def test_marginals_equal_brute_force():
    import itertools
    import math

    import numpy as np

    f = toxic_crf.Field({b"bad": 5.0, b"worse": 2.2})
    f.word[:], f.stem[:] = np.linspace(-1, 2, len(f.word)), np.linspace(0, 1, len(f.stem))
    f.trans, f.bias = np.array([[-0.1, -2.0], [-0.5, -0.9]]), -1.3
    for toks in ([b"bad"], [b"a", b"bad", b"b", b"c", b"worse", b"bad"], [b"x"] * 3 + [b"worse"] + [b"y"] * 2):
        at, w, s = f.features(toks)
        emit = np.full(len(toks), f.bias)
        emit[at] += f.word[w] + f.stem[s]
        total, hit = 0.0, np.zeros(len(toks))
        for line in itertools.product((0, 1), repeat=len(toks)):
            p = math.exp(sum(emit[i] for i, y in enumerate(line) if y) + sum(f.trans[a, b] for a, b in itertools.pairwise(line)))
            total += p
            hit += p * np.array(line)
        assert np.allclose(f.marginals(len(toks), at, w, s), (hit / total)[at])


def test_quality(spark, docs):
    got = {r.doc_id: r for r in adaptive_quality.judge(docs).collect()}
    assert got[3].n_words == 0 and got[3].base_failed and not got[3].kept and got[6].n_repeat_words == 60_000 and got[6].base_failed
    text = "a b c\na b c\n \nx$ y|"
    assert adaptive_quality.counts(text) == (8, 10, 2, 1, 6, 3)
    rows = [(i, " ".join(f"w{random.Random(i * 100 + k).randrange(10**6)}" for k in range(80)) + (" #$%" * 40 if i == 0 else ""), "en", "s") for i in range(60)]
    kept = {r.doc_id: r.kept for r in adaptive_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == {i: i != 0 for i in range(60)}


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "The Quick brown fox, jumps over the lazy dog near the river"), (2, "seven OLD men"), (3, None), (4, "??"), (None, "brown fox"), (2, "seven OLD men")], "item_id long, text string")
    got = {r.doc_id: r for r in positional_index.decontaminate(docs, items).collect()}
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", BASE)
    assert (got[1].n_words, got[1].n_hit, got[1]["items"], got[1].near_items) == (len(words), 15, ["1", "2"], ["1", "2"])
    assert got[3].n_words == 0 and got[6].n_hit == 0 and got[None].contaminated
    assert {r.doc_id for r in positional_index.keep_clean(docs, items).collect()} == {3, 4, 6}
    far = spark.createDataFrame([(1, "seven very old and men"), (2, "old " + "x " * 20 + "seven y men")], "doc_id long, text string")
    assert {r.doc_id for r in positional_index.proximity_matches(far, items.where("item_id = 2"), 4).collect()} == {1}
    assert positional_index.decontaminate(docs, items.where("false")).where("contaminated").count() == 0


def test_language_sample(spark):
    from evoked.llm.lang_fusion import fit_text

    schema = "declared string, text string"
    rows = [("en", "the cat and the dog")] * 50 + [("en", "a house by the sea"), ("en", None), ("fr", "le chat et le chien"), ("fr", ""), (None, "nobody knows")]
    once = spark.createDataFrame(list(dict.fromkeys(rows)), schema)
    model = fit_text(spark.createDataFrame(rows, schema), min_texts=1)
    assert model.languages == ["en", "fr"]
    assert (model.table == fit_text(once, min_texts=1).table).all()  # copies count once
    assert fit_text(spark.createDataFrame([], schema)).languages == []
    assert fit_text(spark.createDataFrame(rows, schema)).languages == ["en"]  # two French texts are too few


def _near_texts(seed):
    """Texts with copies at all similarities, and the shingle set of each."""
    rng, texts = random.Random(seed), []
    for _ in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 12, 60, 150]))]
        texts.append(base)
        for _ in range(12):
            x = list(rng.choice(texts[-3:]) if rng.random() < 0.3 else base)
            for _ in range(rng.randrange(1, 1 + max(1, len(x) // 18))):
                x[rng.randrange(len(x))] = f"w{rng.randrange(5000)}"
            texts.append(x)
    sets = [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in texts]
    return [" ".join(x) for x in texts], sets


def _groups(sets, similarity=0.8):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, y in enumerate(sets):
        for i, x in enumerate(sets[:j]):
            if len(x & y) >= similarity * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_pipeline_near_dedup_recall(spark):
    import corpus_pipeline

    texts, sets = _near_texts(8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert not kept & {i for i, g in enumerate(_groups(sets)) if g != i}  # no near copy is left


def test_pipeline_near_dedup_precision(spark):
    import corpus_pipeline

    texts, sets = _near_texts(9)
    rng = random.Random(10)
    common = [f"c{i}" for i in range(100)]
    for own in (8, 12, 14, 20) * 15:  # meetings of 60, alike by 0.72 to 0.86
        tail = [f"t{rng.randrange(10**6)}" for _ in range(own)]
        x = common + tail if rng.random() < 0.5 else tail + common
        texts.append(" ".join(x))
        sets.append({tuple(x[i : i + 5]) for i in range(len(x) - 4)})
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    out = sorted((r.doc_id, r.component_id) for r in corpus_pipeline.near_copies.near_groups(df).where("doc_id IS NOT NULL").collect())
    assert out == list(enumerate(_groups(sets)))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert kept == {i for i, g in enumerate(_groups(sets)) if g == i}  # and nothing else is dropped, the copy without an id aside


def test_pages_ending_in_a_slash_are_paired(spark):
    rows = [(i, f"http://h.org/{x}/", f"<div>printed on all</div><div>own {x}</div>") for i, x in enumerate(["a", "b", "c/d"])]
    rows.append((9, "http://other.org/a/", "<div>printed on all</div>"))  # another host
    got = {r.page_id: r.text for r in page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "own a", 1: "own b", 2: "own c/d", 9: "printed on all"}


def test_pages_of_large_folders_meet_their_neighbours(spark):
    rows = [(i * 7919 % 1000, f"http://h.org/en/{i:04}", f"<div>run {i // 2}</div><div>own {i}</div>") for i in range(301)]
    got = page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), 8).collect()
    assert len(got) == 301
    # Each page but the last shares a line with one neighbour, before or after it, and with no other page.
    assert {r.text for r in got} == {f"own {i}" for i in range(300)} | {"run 150\n\nown 300"}


def test_pipeline_drops_repeated_short_lines(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(1, "Les.\n\nunlike\nLes."), (2, "Les.\n\nunlikf"), (3, "\u4f60\u597d\n"), (4, "\u4f60\u597d")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, df, "").collect()}
    assert got == {1: "Les.\n\nunlike", 2: "\nunlikf", 3: "\u4f60\u597d\n", 4: ""}
