"""The operators against plain versions of what they compute, on random fixtures."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evoked.llm import adaptive_quality, lang_fusion, page_diff, positional_index, simhash, toxic_crf, url_tree

PAGES = "page_id long, url string, html string"


def _pages(seed, template=True):
    """Pages of some hosts: lines of a template in one order, of which each page has some, and own ones. No line stands twice."""
    rng, rows = random.Random(seed), []
    for h in range(4):
        for i in range(rng.choice([1, 2, 9, 40])):
            path = "/".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
            lines = []
            for k in range(6):
                if template and rng.random() < 0.6:
                    lines.append(f"template {k}")
                if rng.random() < 0.5:
                    lines.append(f"own {h} {i} {k}")
            rows.append((len(rows) * 7 % 101, f"http://h{h}.org/{path}{'/' * rng.randrange(2)}", lines or ["nothing"]))
    return rows


def _differenced(rows):
    """page_id: lines that stay, by the quadratic longest common subsequence."""

    def common(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a) - 1, -1, -1), range(len(b) - 1, -1, -1)):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
        out, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.append(a[i])
                i, j = i + 1, j + 1
            elif t[i + 1][j] >= t[i][j + 1]:
                i += 1
            else:
                j += 1
        return set(out)

    by_host = defaultdict(list)
    for page_id, url, lines in rows:
        host, path = re.fullmatch(r"http://([^/]*)(.*?)/*", url).groups()
        by_host[host].append((path.encode(), page_id, lines))
    out = {}
    for pages in by_host.values():
        pages.sort()
        for k, (_, page_id, lines) in enumerate(pages):
            gone = set()
            for other in pages[max(0, k - 1) : k] + pages[k + 1 : k + 2]:
                both = common(lines, other[2])
                if both != set(lines):
                    gone |= both
            out[page_id] = [x for x in lines if x not in gone]
    return out


@pytest.mark.parametrize("ranges", [1, 7])
def test_page_differencing(spark, ranges):
    rows = _pages(ranges)
    html = [(i, u, "".join(f"<div>{x}</div>" for x in lines)) for i, u, lines in rows]
    got = {r.page_id: r.text for r in page_diff.extract(spark.createDataFrame(html, PAGES), ranges).collect()}
    assert got == {i: "\n\n".join(x) for i, x in _differenced(rows).items()}


def test_alignment_decides(spark, monkeypatch):
    rows = [(i, f"http://h.org/s{i}/p", f"<div>a banner</div><div>own {i}</div><main id=x><p>text {i}</p><div class=box><p>share this</p></div></main>" if i % 2 else f"<div>a banner</div><div>own {i}</div>") for i in range(6)]
    df = spark.createDataFrame(rows, PAGES)
    got = {r.page_id: (r.text, r.n_shared) for r in page_diff.extract(df).collect()}
    assert got[0] == ("own 0", 1) and got[2] == ("own 2", 1) and got[1][0] == "text 1\n\nshare this"
    same = spark.createDataFrame([r for r in rows if r[0] % 2], PAGES)
    assert {r.text for r in page_diff.extract(same).collect()} == {"text 1", "text 3", "text 5"}  # a block that all print
    alone = [page_diff.Page((), page_diff.lines_of(r[2])).text()[0] for r in rows]
    assert alone[0] == "a banner\n\nown 0" and alone[1] == "text 1\n\nshare this"  # without neighbours


def _tree_verdicts(urls, rules):
    """The url tree by recursion over plain dicts."""

    def typed(s):
        for pattern, name in ((r"^\d{4}-\d{2}-\d{2}", "{date}"), (r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "{uuid}"), (r"^(?=[a-f]*\d)[0-9a-f]{12,}", "{hex}"), (r"^\d+", "{n}")):
            s = re.sub(pattern, name, s)
        return s

    def label(host, path):
        fits = [(len(h + p), i, v) for i, (v, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2] if fits else None

    class Node:
        def __init__(self):
            self.urls, self.kids, self.purity = [], {}, None

        def fill(self, urls, depth):
            self.urls = urls
            deeper = [u for u in urls if len(u[1]) > depth]
            names = {u[1][depth] for u in deeper}
            star = len(names) >= url_tree.CHILDREN and len(deeper) / len(names) < url_tree.MEAN
            for u in deeper:
                if star:
                    u[1][depth] = "*"
            for name in {u[1][depth] for u in deeper}:
                self.kids[name] = Node()
                self.kids[name].fill([u for u in deeper if u[1][depth] == name], depth + 1)
            self.weigh(depth)

        def numbers(self, depth):
            got = [u[2] for u in self.urls if u[2]]
            return got.count("block"), len(got), len(self.urls), sum(len(u[1]) > depth for u in self.urls), sum(len(u[1]) > depth + 1 for u in self.urls)

        def weigh(self, depth):
            kids = {k: v.numbers(depth + 1) for k, v in self.kids.items()}
            near = lambda x, n, p: abs(x - p) <= url_tree.Z * math.sqrt(max(p * (1 - p), 0) / max(n, 1)) + 1e-9
            p = sum(b for b, *_ in kids.values()) / max(1, sum(n for _, n, *_ in kids.values()))
            alike = {k for k, (b, n, *_) in kids.items() if n and near(b / n, n, p)}
            sums = [sum(kids[k][i] for k in alike) for i in range(5)]
            for k, (b, n, size, *on) in kids.items():
                joins = not n and len(alike) >= 2 and all(near(x / size, size, y / sums[2]) for x, y in zip(on, sums[3:], strict=True))
                if k in alike or joins:
                    b, n = sums[:2]
                self.kids[k].purity = (b + url_tree.PRIOR_BAD * url_tree.PRIOR_ALL) / (n + url_tree.PRIOR_ALL) if n else None

        def find(self, segments, above):
            own = self.purity if self.purity is not None else above
            return self.kids[segments[0]].find(segments[1:], own) if segments else own

    hosts = defaultdict(list)
    for i, url in urls:
        host, path = re.fullmatch(r"[a-z]+://([^/?#]*)([^?#]*).*", url).groups()
        hosts[host].append((i, [typed(s) for s in path.split("/") if s], label(host, path)))
    out = {}
    for rows in hosts.values():
        root = Node()
        root.fill(rows, 0)
        for i, segments, known in rows:
            out[i] = known or ("block" if root.find(segments, url_tree.PRIOR_BAD) >= url_tree.REJECT else "allow")
    return out


RULES = (("block", "x.org", "/bad/"), ("block", "x.org", "/worse/"), ("allow", "x.org", "/good/"), ("block", "y.org", "/u/a"), ("allow", "z.org", "/ok/"), ("block", "deep.org", "/1/2/3/4/5/bad"))
NAMES = ["".join(x) for x in itertools.product("abcdef", repeat=2)]
RULES += tuple(x for n in NAMES for x in (("block", "w.org", f"/u/{n}/spam"), ("allow", "w.org", f"/u/{n}/post")))


def _urls():
    rng, urls = random.Random(3), []
    for s in ("bad", "worse"):  # merged, and their shape with them
        urls += [f"http://x.org/{s}/{i}" for i in range(30)]
    urls += [f"http://x.org/like/{i}" for i in range(30)] + [f"http://x.org/unlike/{i}/{i}" for i in range(30)]  # without labels
    urls += [f"http://m.x.org/{s}/{i}" for s in ("bad", "good", "like") for i in range(20)]  # labels differ: no merging
    names = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(90)]
    urls += [f"http://y.org/u/{n}/post" for n in names] + ["http://y.org/u/zoe/post", "http://y.org/v/zoe/post"]  # a wildcard
    urls += [f"http://y.org/u/a{n}/post" for n in names * 9]
    urls += [f"http://deep.org/1/2/3/4/5/{s}/{i}" for s in ("bad1", "bad2", "other") for i in range(9)]  # deeper than four levels
    urls += [f"http://z.org/{s}/{i}" for s in ("ok", "new") for i in range(9)]
    urls += [f"http://w.org/u/{n}/{s}" for n in [*NAMES, "zoe"] for s in ("spam", "post")]  # a wildcard sets spam apart from post
    return list(enumerate(urls))


def test_url_tree(spark):
    urls = _urls()
    df = spark.createDataFrame(urls, "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_tree.judge(df, RULES).collect()}
    assert got == _tree_verdicts(urls, RULES)
    of = {u: got[i] for i, u in urls}
    assert of["http://x.org/like/3"] == "block" and of["http://x.org/unlike/3/3"] == "allow" and of["http://m.x.org/like/3"] == "allow"
    assert of["http://w.org/u/zoe/spam"] == "block" and of["http://w.org/u/zoe/post"] == "allow"
    assert of["http://y.org/u/zoe/post"] == "block" and of["http://y.org/v/zoe/post"] == "allow"
    assert of["http://deep.org/1/2/3/4/5/other/3"] == "block"


@pytest.mark.parametrize("name, value, url", [("CHILDREN", 10**6, "http://w.org/u/zoe/spam"), ("_alike", lambda *_: F.lit(False), "http://x.org/like/3"), ("REJECT", 1.1, "http://x.org/like/3")])
def test_each_part_of_the_tree_decides(spark, monkeypatch, name, value, url):
    """Without wildcards, merging or rejection a verdict changes."""
    monkeypatch.setattr(url_tree, name, value)
    df = spark.createDataFrame([x for x in _urls() if x[1][:12] in url], "page_id long, url string")
    assert url_tree.judge(df, RULES).where(F.col("url") == url).first().verdict == "allow"


def test_fusion(spark):
    rng, langs = random.Random(7), ["de", "en", "fr"]
    rows = []
    for i in range(200):
        host = f"h{rng.randrange(6)}.{rng.choice(['de', 'org'])}" if rng.random() < 0.9 else ""
        rows.append((i, [rng.uniform(-9, 0) for _ in langs], rng.choice([None, "de", "en", "xx"]), host.rpartition(".")[2] or None, ".".join(host.split(".")[-2:]), host))
    df = spark.createDataFrame(rows, "page_id long, loglik array<double>, declared string, suffix string, domain string, host string")
    got = {r.page_id: (r.lang, r.confidence) for r in lang_fusion.fuse(df, langs).collect()}

    def soft(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    p = [soft(r[1]) for r in rows]
    total = [sum(x) for x in zip(*p, strict=True)]
    base = [(t + 1) / (len(rows) + 3) for t in total]

    def drawn(key, above):
        sums, n = defaultdict(lambda: [0.0] * 3), Counter()
        for r, x in zip(rows, p, strict=True):
            if (k := key(r)) is not None:
                n[k] += 1
                sums[k] = [a + b for a, b in zip(sums[k], x, strict=True)]
        s = lang_fusion.STRENGTH
        return {k: [(sums[k][i] + s * above(k)[i]) / (n[k] + s) for i in range(3)] for k in n}

    domains = drawn(lambda r: r[4], lambda k: base)
    hosts = drawn(lambda r: (r[4], r[5]), lambda k: domains[k[0]])
    declared, suffix = drawn(lambda r: r[2], lambda k: base), drawn(lambda r: r[3], lambda k: base)
    for r in rows:
        score = [r[1][i] + math.log(hosts[r[4], r[5]][i]) + sum(math.log(t[k][i] / base[i]) for t, k in ((declared, r[2]), (suffix, r[3])) if k is not None) for i in range(3)]
        want = soft(score)
        assert got[r[0]][0] == langs[want.index(max(want))] and abs(got[r[0]][1] - max(want)) < 1e-9


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 60, 400):
        words = [rng.choice(["Über", "The", "a", "b", "c", "　x"]) for _ in range(n)]
        text = " \t".join(words) + "\n"
        low = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words]
        shingles = [" ".join(low[i : i + 4]) for i in range(max(1, n - 3))] if n else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text, 4) == want


def test_adaptive_limits(spark):
    rng, rows = random.Random(9), []
    for i in range(400):
        lang, source = rng.choice([("en", "a"), ("en", "b"), ("de", "a"), ("fr", None), (None, "c")])
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 12 if source == "b" else 6))) for _ in range(rng.randrange(40, 90))]
        if rng.random() < 0.2:
            words += ["#$%&"] * rng.randrange(60)
        text = " ".join(words)
        if rng.random() < 0.2:
            text += "\nsame line\nsame line" * rng.randrange(1, 9)
        rows.append((i, text, lang, source))
    got = {r.doc_id: r.kept for r in adaptive_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}

    values, failed = {}, {}
    for i, text, _, _ in rows:
        words = text.split()
        lines = [x for x in text.split("\n") if x.split()]
        triples = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        many = Counter(triples)
        repeat = {k + j for k, t in enumerate(triples) if many[t] > 1 for j in range(3)}
        failed[i] = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
        values[i] = (sum(map(len, words)) / len(words), len(re.findall(r"[#*$%&|<>]", text)) / len(words), (len(lines) - len(set(lines))) / len(lines), len(repeat) / len(words))
    least = [s for _, s in adaptive_quality.METRICS.values()]

    def bucket(x):
        return 0 if x < 1e-6 else math.floor(math.log(x / 1e-6) / math.log(adaptive_quality.RATIO)) + 1

    def quartiles(ids, m):
        b = sorted(bucket(values[i][m]) for i in ids)
        mid = lambda k: 0.0 if k == 0 else 1e-6 * adaptive_quality.RATIO ** (k - 0.5)
        return [mid(b[math.ceil(q * len(b)) - 1]) for q in (0.25, 0.75)]

    good = [r for r in rows if not failed[r[0]]]
    for i, _, lang, source in rows:
        ok = not failed[i]
        for m in range(4):
            groups = [[r[0] for r in good if r[2:] == (lang, source)], [r[0] for r in good if r[2] == lang], [r[0] for r in good]]
            ids = next((g for g in groups[:2] if len(g) >= adaptive_quality.MIN_GROUP), groups[2])
            lo, hi = quartiles(ids, m)
            spread = adaptive_quality.FENCE * max(hi - lo, least[m])
            ok = ok and lo - spread <= values[i][m] <= hi + spread
        assert got[i] == ok


def _matches(docs, items, slop, window=10):
    """(n_words, n_hit, items, near items) by scanning every document for every window."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    texts = [cut(t) for _, t in docs]
    freq = Counter(w for t in texts for w in t)
    out = []
    for words in texts:
        hit, own, near = set(), set(), set()
        for item, text in items:
            w = cut(text)
            for i in range(max(len(w) - window, 0) + 1 if w else 0):
                run = w[i : i + window]
                for k in range(len(words) - len(run) + 1):
                    if words[k : k + len(run)] == run:
                        hit |= set(range(k, k + len(run)))
                        own.add(item)
                if all(freq[x] for x in run):
                    rare = sorted((freq[x], j) for j, x in enumerate(run))[:3]
                    starts = [{k - j for k, x in enumerate(words) if x == run[j]} for _, j in rare]
                    if any(all(any(s <= x <= s + slop for x in part) for part in starts) for s in set().union(*starts)):
                        near.add(item)
        out.append((len(words), len(hit), sorted(str(x) for x in own if x is not None), sorted(str(x) for x in near if x is not None)))
    return out


@pytest.mark.parametrize("rows", [positional_index.BROADCAST_ROWS, 0])
def test_index(spark, monkeypatch, rows):
    """Broadcast, and joined by shuffles."""
    monkeypatch.setattr(positional_index, "BROADCAST_ROWS", rows)
    rng = random.Random(4)
    items = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([4, 10, 14])))) for k in (1, 2, 3, 30)] + [(None, "p q r s")] + [(5, None), (6, "?!"), (7, "zz zz")]
    docs = []
    for i in range(40):
        words = [rng.choice("abcdefghij") for _ in range(rng.randrange(30))]
        if rng.random() < 0.5:
            words[rng.randrange(len(words) + 1) :] = (rng.choice(items)[1] or "").upper().split()
        docs.append((i if i else None, "-".join(words)))
    docs += [(50, None), (51, ""), docs[3]]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.near_items, r.contaminated) for r in positional_index.decontaminate(df, it).collect())
    want = sorted((str(d[0]), *m, m[1] > 0) for d, m in zip(docs, _matches(docs, items, positional_index.SLOP), strict=True))
    assert got == want and any(w[2] and not w[3] for w in want)  # some are hit by the item without an id alone
    assert positional_index.build(df).count() == sum(w[1] + 1 for w in want)  # without terms: all postings


def test_gradient():
    rng = np.random.default_rng(3)
    n = 4
    rows = [tuple(rng.integers(0, m, size).astype(np.uint8).tobytes() for m in (n, n, 2)) for size in (1, 2, 5, 5, 3)]
    rows.append(rows[0])
    seqs, theta = toxic_crf.Sequences(rows), rng.normal(size=2 * n + 5)

    def brute(t):
        trans, total = t[2 * n + 1 :].reshape(2, 2), 0.0
        for w, s, y in rows:
            emit = [t[a] + t[n + b] + t[2 * n] for a, b in zip(w, s, strict=True)]
            value = lambda line: sum(e for e, x in zip(emit, line, strict=True) if x) + sum(trans[a, b] for a, b in itertools.pairwise(line))  # noqa: B023, E731
            total += value(y) - math.log(sum(math.exp(value(z)) for z in itertools.product((0, 1), repeat=len(y))))
        return total

    value, g = seqs.likelihood(theta, n)
    assert abs(value - brute(theta)) < 1e-9
    for k in range(len(theta)):
        e = np.eye(len(theta))[k] * 1e-5
        assert abs((brute(theta + e) - brute(theta - e)) / 2e-5 - g[k]) < 1e-6
    assert np.allclose(toxic_crf.maximise(lambda x: (-float(x @ x - x.sum()), 1 - 2 * x), np.zeros(3)), 0.5)
