"""Toxicity by a linear-chain conditional random field over tokens.

Labels say which documents are toxic, not which tokens. The field is fitted on a bounded sample of labelled documents: at most
``SAMPLE`` of either label, chosen by hash among all that may be learnt from, whole, whatever their length. The sample is in two
folds. Each gives words and word beginnings smoothed log-odds of standing in toxic documents. A token of a toxic document is
labelled toxic by the odds of the document's own fold; its features are the odds, in steps, that the other fold gives it and
its beginning. So labels are no threshold of the features, and the field learns what odds are worth on documents they were
not counted on, and what a neighbour's label is worth besides.

Emissions, bias and transitions are fitted together by maximum likelihood (L-BFGS; gradients from forward-backward) on at
most ``WINDOWS`` windows of ``LENGTH`` tokens of each document, chosen by hash. For scoring, features come from both folds.
Forward-backward over the whole text gives each token's marginal; runs of toxic tokens are the offending offsets, and a
logistic fit turns a document's marginals into its score.

A token without a feature (nearly all) has the same factor everywhere, so a run of n of them is the n-th power of one
2 x 2 matrix: forward-backward goes over the tokens that have features only, exactly, and whole texts stay cheap.

labels, lang, source and doc_id are never inputs of a score.

Cases: null and empty texts have no tokens and get the score of such a text; texts of any length are read whole; labels
without a document, null labels and repeated labels (the largest counts) are harmless; a labelled doc_id with several texts is
learnt from by its smallest; without labels of both kinds every score is 0; rows that are repeated or share doc_id are scored
each by itself; empty tables give no rows; the columns of the input stay, but for those named score and toxic_spans.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoked.llm.common import checkpoint, packed, table, unpacked

#: At most so many toxic and as many other documents are fitted on: the bound of all that is learnt.
SAMPLE = 4000
#: Windows of a sampled document that transitions and emissions are fitted on, and their tokens.
WINDOWS, LENGTH = 2, 64
#: A term counts from so many toxic documents of a fold on, and from such log-odds on.
MIN_DOCS, MIN_ODDS = 2, 1.5
#: Odds in its own fold from which a token of a toxic document is labelled toxic.
TOKEN_ODDS = 3.0
#: Characters in a word's beginning.
STEM = 5
THRESHOLD = 0.3
STEPS = (1.5, 2.0, 2.5, 3.0, 4.0, 5.0)
#: Strength of the field's prior, per weight.
RIDGE = 0.05
#: Letters stay, everything else in ASCII separates tokens.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) that may be learnt from: crc32(doc_id as text) mod 4 is not 2."""
    y = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    return y.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def sample(docs: DataFrame, labels: DataFrame, n: int = SAMPLE) -> tuple[DataFrame, float]:
    """(doc_id, text, toxic, fold) of at most ``n`` documents of either label, those with the smallest hashes of doc_id; and the
    share of toxic ones among all that may be learnt from. Ids are chosen first; only the texts of those chosen move."""
    spark = docs.sparkSession
    known = checkpoint(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct().join(learnable(labels).hint("merge"), "doc_id"))
    share = known.agg(F.avg(F.col("toxic").cast("int"))).first()[0] or 0.0
    chosen = [(r.doc_id, t) for t in (True, False) for r in known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    ids = F.broadcast(spark.createDataFrame(chosen, "doc_id long, toxic boolean"))
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return checkpoint(texts.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int"))), share


def terms_of(toks: list[bytes]) -> set[bytes]:
    own = set(toks)
    return own | {t[:STEM] + b"*" for t in own if len(t) > STEM}


def term_odds(learnt: DataFrame) -> tuple[dict[bytes, float], dict[bytes, float], dict[bytes, float]]:
    """Terms that toxic documents have more often than others, with log-odds: by fold 0, by fold 1, and by both."""

    def terms(batches):
        for b in batches:
            seen: dict[tuple, list[int]] = {}
            for text, toxic, fold in zip(b["text"], b["toxic"], b["fold"], strict=True):
                for t in (None, *terms_of(tokens(text))):
                    seen.setdefault((t, fold), [0, 0])[bool(toxic)] += 1
            yield pd.DataFrame([(*k, *n) for k, n in seen.items()], columns=["term", "fold", "other", "bad"])

    kind = "term binary, fold int, other long, bad long"
    counts = learnt.select("text", "toxic", "fold").mapInPandas(terms, kind).groupBy("term").pivot("fold", [0, 1]).agg(F.sum("other").alias("other"), F.sum("bad").alias("bad")).fillna(0)
    counts = checkpoint(counts.where(f"term IS NULL OR greatest(`0_bad`, `1_bad`) >= {MIN_DOCS}"))
    whole = counts.where("term IS NULL").first()
    out: list[dict] = []
    for folds in ((0,), (1,), (0, 1)):
        bad, other = (sum((F.col(f"{f}_{c}") for f in folds), F.lit(0)) for c in ("bad", "other"))
        n_bad, n_other = (sum(whole[f"{f}_{c}"] for f in folds) if whole else 0 for c in ("bad", "other"))
        if not n_bad or not n_other:
            return {}, {}, {}
        odds = F.log((bad + 0.5) / (n_bad + 1.0)) - F.log((other + 0.5) / (n_other + 1.0))
        rows = counts.where("term IS NOT NULL").where(bad > MIN_DOCS - 1 + len(folds) // 2).select("term", odds.alias("odds")).where(F.col("odds") >= MIN_ODDS)
        out.append({bytes(r.term): r.odds for r in rows.collect()})
    return tuple(out)


def strength(odds: dict[bytes, float], token: bytes) -> float:
    return max(odds.get(token, 0.0), odds.get(token[:STEM] + b"*", 0.0) if len(token) > STEM else 0.0)


def windows(field: Field, odds: dict[bytes, float], text: str, toxic: bool, key: int) -> list[tuple[bytes, bytes, bytes]]:
    """(features of words, of beginnings, labels) of the document's windows that are fitted on, a byte a token."""
    toks = tokens(text)
    starts = sorted(range(0, len(toks), LENGTH), key=lambda i: xxhash.xxh64_intdigest(f"{key} {i}"))[:WINDOWS]
    out = []
    for i in starts:
        part = toks[i : i + LENGTH]
        at, w, s = field.features(part)
        words, stems = np.zeros(len(part), np.uint8), np.zeros(len(part), np.uint8)
        words[at], stems[at] = w, s
        y = np.array([toxic and strength(odds, t) >= TOKEN_ODDS for t in part], np.uint8)
        out.append((words.tobytes(), stems.tobytes(), y.tobytes()))
    return out


class Sequences:
    """Equal-length windows in arrays, equal ones once with their number; masked beyond their ends."""

    def __init__(self, rows: list[tuple[bytes, bytes, bytes]]):
        many = Counter(rows)
        self.weight = np.array(list(many.values()), float)
        self.size = np.array([len(r[0]) for r in many])
        shape = (len(many), int(self.size.max(initial=1)))
        self.word, self.stem, self.y = (np.zeros(shape, np.int64) for _ in range(3))
        for i, r in enumerate(many):
            for a, x in zip((self.word, self.stem, self.y), r, strict=True):
                a[i, : len(x)] = np.frombuffer(x, np.uint8)
        self.inside = np.arange(shape[1])[None, :] < self.size[:, None]

    def likelihood(self, theta: np.ndarray, n: int) -> tuple[float, np.ndarray]:
        """The log-likelihood of the labels and its gradient. theta: ``n`` word weights, ``n`` of beginnings, the bias, the
        transitions from 0 to 0, 0 to 1, 1 to 0 and 1 to 1."""
        word, stem, bias, trans = theta[:n], theta[n : 2 * n], theta[2 * n], theta[2 * n + 1 :].reshape(2, 2)
        emit = bias + word[self.word] + stem[self.stem]
        rows, length = self.y.shape
        logs = lambda a, b: np.logaddexp(a, b)
        fore = np.zeros((length, rows, 2))
        fore[0, :, 1] = emit[:, 0]
        for t in range(1, length):
            x, y = fore[t - 1, :, 0], fore[t - 1, :, 1]
            new = np.stack([logs(x + trans[0, 0], y + trans[1, 0]), logs(x + trans[0, 1], y + trans[1, 1]) + emit[:, t]], 1)
            fore[t] = np.where(self.inside[:, t, None], new, fore[t - 1])
        total = logs(fore[-1, :, 0], fore[-1, :, 1])
        back = np.zeros((rows, 2))
        g, w = np.zeros_like(theta), self.weight
        seen = 0.0
        for t in range(length - 1, -1, -1):
            here = self.inside[:, t]
            p1 = np.where(here, np.exp(fore[t, :, 1] + back[:, 1] - total), 0.0)
            d = w * (np.where(here, self.y[:, t], 0) - p1)
            g[:n] += np.bincount(self.word[:, t], d, n)
            g[n : 2 * n] += np.bincount(self.stem[:, t], d, n)
            g[2 * n] += d.sum()
            seen += float((w * np.where(here, self.y[:, t] * emit[:, t], 0)).sum())
            if not t:
                break
            into = np.stack([back[:, 0], back[:, 1] + emit[:, t]], 1)
            both = fore[t - 1, :, :, None] + trans[None] + into[:, None, :] - total[:, None, None]
            expected = np.where(here[:, None, None], np.exp(np.where(here[:, None, None], both, 0.0)), 0.0)
            g[2 * n + 1 :] -= (w[:, None, None] * expected).sum(0).ravel()
            pairs = np.bincount((2 * self.y[:, t - 1] + self.y[:, t])[here], w[here], 4)
            g[2 * n + 1 :] += pairs
            seen += float(pairs @ trans.ravel())
            new = np.stack([logs(trans[0, 0] + into[:, 0], trans[0, 1] + into[:, 1]), logs(trans[1, 0] + into[:, 0], trans[1, 1] + into[:, 1])], 1)
            back = np.where(here[:, None], new, back)
        return seen - float(w @ total), g


def maximise(f, x: np.ndarray, steps: int = 80, memory: int = 8) -> np.ndarray:
    """L-BFGS with halving steps. f gives the value and its gradient."""
    value, g = f(x)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, weights = g.copy(), []
        for s, y in reversed(held):
            weights.append((s @ q) / (y @ s))
            q -= weights[-1] * y
        q *= (held[-1][0] @ held[-1][1]) / (held[-1][1] @ held[-1][1]) if held else 1 / max(1.0, np.abs(g).sum())
        for (s, y), c in zip(held, reversed(weights), strict=True):
            q += s * (c - (y @ q) / (y @ s))
        # Moves are up the gradient g of f, so y, the change of -g, has s @ y > 0.
        rate = 1.0
        while rate > 1e-6:
            new, new_g = f(x + rate * q)
            if new >= value + 1e-4 * rate * (g @ q):
                break
            rate /= 2
        else:
            break
        s, y = rate * q, g - new_g
        if s @ y > 1e-12:
            held = [*held, (s, y)][-memory:]
        gain, x, value, g = new - value, x + s, new, new_g
        if gain < 1e-7 * max(1.0, abs(value)):
            break
    return x


class Field:
    """Two states; weights: start and transition scores, and a score for toxic of each step of both features."""

    def __init__(self, odds: dict[bytes, float]):
        self.feature = {t: 1 + sum(o >= s for s in STEPS) for t, o in odds.items()}
        n = len(STEPS) + 2
        self.word, self.stem = np.zeros(n), np.zeros(n)
        self.bias, self.trans = -2.0, np.array([[0.0, -1.0], [-1.0, 0.0]])
        self.fit_document = np.zeros(4)
        self.usable = bool(odds)

    def features(self, toks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the tokens that have a feature, and the features of word and beginning."""
        get, w = self.feature.get, []
        for t in set(toks):
            x, y = get(t, 0), get(t[:STEM] + b"*", 0) if len(t) > STEM else 0
            if x or y:
                w.append((t, x, y))
        if not w:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        own = {t: (x, y) for t, x, y in w}
        at = [i for i, t in enumerate(toks) if t in own]
        pairs = [own[toks[i]] for i in at]
        return np.array(at), np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])

    def marginals(self, n: int, at: np.ndarray, w: np.ndarray, s: np.ndarray) -> np.ndarray:
        """P(toxic) of the tokens at ``at`` by forward-backward over all n tokens, runs without features as powers."""
        if not len(at):
            return np.empty(0)
        (s00, s01), (s10, s11) = np.exp(self.trans).tolist()
        e = math.exp(self.bias)
        # M = [[s00, s01 e], [s10, s11 e]] = l1 P1 + l2 P2, and M^k / l1^k = P1 + (l2 / l1)^k P2.
        m00, m01, m10, m11 = s00, s01 * e, s10, s11 * e
        mid, root = (m00 + m11) / 2, math.sqrt((m00 - m11) ** 2 / 4 + m01 * m10)
        l1, l2 = mid + root, mid - root
        p00, p01, p10, p11 = (m00 - l2) / (2 * root), m01 / (2 * root), m10 / (2 * root), (m11 - l2) / (2 * root)

        def run(k: int) -> tuple[float, float, float, float]:
            r = (l2 / l1) ** k
            return p00 + r * (1 - p00), p01 * (1 - r), p10 * (1 - r), p11 + r * (1 - p11)

        emit = np.exp(np.clip(self.bias + self.word[w] + self.stem[s], -30, 30)).tolist()
        places = at.tolist()
        fore, last = [], -1
        for i, g in zip(places, emit, strict=True):
            gap = i - last - 1
            if last < 0:  # the first token has no transition before it
                if gap:
                    q00, q01, q10, q11 = run(gap - 1)
                    x, y = q00 + e * q10, q01 + e * q11
                    x, y = x * s00 + y * s10, x * s01 + y * s11
                else:
                    x = y = 1.0
            else:
                if gap:
                    q00, q01, q10, q11 = run(gap)
                    x, y = x * q00 + y * q10, x * q01 + y * q11
                x, y = x * s00 + y * s10, x * s01 + y * s11
            y *= g
            x, y = x / (x + y), y / (x + y)
            fore.append((x, y))
            last = i
        q00, q01, q10, q11 = run(n - last - 1)
        x, y, out = q00 + q01, q10 + q11, [0.0] * len(places)
        for k in range(len(places) - 1, -1, -1):
            a, b = fore[k]
            out[k] = b * y / (a * x + b * y)
            y *= emit[k]
            x, y = s00 * x + s01 * y, s10 * x + s11 * y
            if k and (gap := places[k] - places[k - 1] - 1):
                q00, q01, q10, q11 = run(gap)
                x, y = q00 * x + q01 * y, q10 * x + q11 * y
            x, y = x / (x + y), y / (x + y)
        return np.array(out)

    def with_odds(self, odds: dict[bytes, float]) -> Field:
        """The same weights over other odds."""
        other = Field(odds)
        other.word, other.stem, other.bias, other.trans, other.fit_document = self.word, self.stem, self.bias, self.trans, self.fit_document
        return other

    def fit(self, rows: list[tuple[bytes, bytes, bytes]]) -> None:
        """Maximum likelihood of the windows' labels."""
        rows = [r for r in rows if r[0]]
        if not rows:
            return
        seqs, n = Sequences(rows), len(self.word)
        ridge = np.full(2 * n + 5, RIDGE)

        def weights(steps: np.ndarray) -> np.ndarray:
            """A step's weight is the sum of what it and those below it add, so that steps that no window has are not worth less
            than those below."""
            out = steps.copy()
            out[:n], out[n : 2 * n] = np.cumsum(steps[:n]), np.cumsum(steps[n : 2 * n])
            return out

        def penalised(steps):
            value, g = seqs.likelihood(weights(steps), n)
            g[:n], g[n : 2 * n] = np.cumsum(g[:n][::-1])[::-1], np.cumsum(g[n : 2 * n][::-1])[::-1]
            g -= 2 * ridge * steps
            g[0] = g[n] = 0.0  # no feature, no weight
            return value - float(ridge @ steps**2), g

        theta = weights(maximise(penalised, np.concatenate([np.zeros(2 * n), [self.bias], self.trans.ravel()])))
        self.word, self.stem, self.bias, self.trans = theta[:n], theta[n : 2 * n], float(theta[2 * n]), theta[2 * n + 1 :].reshape(2, 2)

    def fit_score(self, x: np.ndarray, y: np.ndarray) -> None:
        """A ridge logistic fit of the documents' labels to their summaries, by Newton steps."""
        beta = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(beta))
            step = np.linalg.solve(h, x.T @ (y - p) - 0.01 * beta)
            beta = beta + step
            if np.abs(step).max() < 1e-6:
                break
        self.fit_document = beta

    def summary(self, toks: list[bytes]) -> list[float]:
        m = self.marginals(len(toks), *self.features(toks)) if toks else np.empty(0)
        return [1.0, float(m.max(initial=0)), math.log1p(m.sum()), math.log1p(100 * m.sum() / max(1, len(toks)))]

    def score(self, toks: list[bytes]) -> float:
        z = float(np.dot(self.summary(toks), self.fit_document))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) if self.usable else 0.0

    def spans(self, text: str, least: float = 0.5) -> list[tuple[int, int]]:
        """Code point offsets (start, end) of the runs of tokens whose marginal is at least ``least``."""
        low = (text or "").lower()
        if len(low) != len(text or ""):  # a letter that grows when lower-cased keeps its own form
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        raw = low.encode("utf-8", "surrogatepass")
        flat, toks, places, end = raw.translate(_TABLE), [], [], 0
        for t in flat.split():
            start = flat.index(t, end)
            end = start + len(t)
            toks.append(t)
            places.append((start, end))
        if not self.usable or not toks:
            return []
        at, w, s = self.features(toks)
        bad = at[self.marginals(len(toks), at, w, s) >= least] if len(at) else []
        out: list[list[int]] = []
        for i in bad:
            if out and out[-1][1] == i - 1:
                out[-1][1] = int(i)
            else:
                out.append([int(i), int(i)])
        chars = lambda n: len(raw[:n].decode("utf-8", "surrogatepass"))
        return [(chars(places[a][0]), chars(places[b][1])) for a, b in out]


def fit_field(docs: DataFrame, labels: DataFrame, n: int = SAMPLE) -> Field:
    learnt, share = sample(docs, labels, n)
    *folds, both = term_odds(learnt)
    field = Field(both)
    if not both or not 0 < share < 1:
        field.usable = False
        return field
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((folds, [Field(o) for o in folds]))

    def cut(batches):
        odds, fields = held.value
        for b in batches:
            rows = [w for i, text, toxic, f in zip(b["doc_id"], b["text"], b["toxic"], b["fold"], strict=True) for w in windows(fields[1 - f], odds[f], text, toxic, i)]
            yield pd.DataFrame(rows, columns=["w", "s", "y"])

    field.fit([tuple(bytes(x) for x in r) for r in learnt.mapInPandas(cut, "w binary, s binary, y binary").collect()])
    crossed = spark.sparkContext.broadcast([field.with_odds(o) for o in folds])

    def sum_up(batches):
        fields = crossed.value
        for b in batches:
            yield pd.DataFrame({"x": [fields[1 - f].summary(tokens(t)) for t, f in zip(b["text"], b["fold"], strict=True)], "y": b["toxic"]})

    rows = learnt.mapInPandas(sum_up, "x array<double>, y boolean").collect()
    y = np.array([r.y for r in rows], float)
    field.fit_score(np.array([r.x for r in rows]), y)
    # The sample has another share of toxic documents than the labels, whose share the score is to hold for.
    field.fit_document[0] += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    return field


def score(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with score and toxic_spans. The field is of bounded size and broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("score double, spans array<struct<start:int,end:int>>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        f = held.value
        return pd.DataFrame({"score": [f.score(tokens(t)) for t in texts], "spans": [[{"start": a, "end": b} for a, b in f.spans(t)] if t else [] for t in texts]})

    judged = packed(docs, judge(F.col(text)).alias("_judged"))
    return unpacked(judged, docs.columns, F.col("_judged.score").alias("score"), F.col("_judged.spans").alias("toxic_spans"), names=("score", "toxic_spans"))


def scores_only(text: Column, df: DataFrame, field: Field) -> Column:
    held = df.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        f = held.value
        return pd.Series([f.score(tokens(t)) for t in texts], dtype="float64")

    return judge(text)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = fit_field(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", scores_only(F.col("text"), docs, field).alias("score"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    field = fit_field(docs, labels)
    return docs.where(scores_only(F.col("text"), docs, field) < THRESHOLD)
