"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence about a text add up as logarithms: the likelihood of its byte trigrams (hashed), the language that
its markup declares, the suffix of its address, and the prior of its host. Likelihoods are fitted on a bounded sample of
texts with a declared language, whole, whatever their length; how far declarations and suffixes can be trusted is counted over all rows, against the
languages that the texts alone speak for. A host's prior is its share of those, drawn towards that of its domain,
and that towards the whole, all by grouped aggregation. Long texts would drown all else: trigrams of one text depend
on each other, so their mean decides, times at most ``EVIDENCE`` of them.

Pages have all four; documents have text and source, which stands for the host. No label column of documents is read.

Each language that at least ``MIN_TEXTS`` different texts declare has a model of a fixed size, and there are as many as the
pattern of declarations has codes, 18,252, at most.

Cases: null and empty texts rest on the other evidence; without any evidence the most frequent language wins; texts of any
length are read whole; languages that too few texts declare have no model, and their declarations are evidence like any
other value; of languages with equal posteriors the first in the alphabet wins; repeated rows keep a row each, and equal
texts are fitted on once; empty tables give no rows; without a sample every language is "und"; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evoked.llm.common import checkpoint, lower_ascii, small, table
from evoked.llm.url_tree import host_and_path

#: Texts for each language that are fitted on, at most, and from how many different ones on a language has a model.
SAMPLE, MIN_TEXTS = 300, 3
BINS = 1 << 15
#: Trigrams that count as independent, at most.
EVIDENCE = 60.0
#: Rows that a host's, a domain's and a suffix's or declaration's own counts are weighed against.
STRENGTH = 20.0
BROADCAST_ROWS = 200_000
_TAGS = r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, and where each text's begin."""
    sizes = np.array([max(0, len(t) - 2) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(t for t in texts if len(t) > 2), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    grams = (raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA6B) ^ raw[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(17)
    keep, at = np.ones(len(grams), bool), 0
    for t in texts:
        if len(t) > 2:
            at += len(t)
            keep[max(0, at - 2) : at] = False
    return grams[keep], np.concatenate(([0], np.cumsum(sizes)))


def _clean(text: str | None) -> bytes:
    return (" " + (text or "").lower() + " ").encode("utf-8", "surrogatepass")


class TextModel:
    def __init__(self, counts: dict[str, np.ndarray]):
        """counts: of each language, how often each hashed trigram stands in its sample."""
        self.languages = sorted(counts)
        self.table = np.zeros((BINS, max(1, len(counts))), np.float32)
        for k, lang in enumerate(self.languages):
            n = counts[lang] + 0.5
            self.table[:, k] = np.log(n / n.sum())

    def log_likelihoods(self, texts: list[str | None]) -> np.ndarray:
        """One row a text: its trigrams' mean log-likelihoods, times as many of them as count."""
        out = np.zeros((len(texts), self.table.shape[1]))
        step, at = 200, 0
        raws = [_clean(t) for t in texts]
        while at < len(texts):
            grams, edges = _codes(raws[at : at + step])
            for i in range(len(edges) - 1):
                a, b = edges[i], edges[i + 1]
                if b - a > 2:
                    whole = np.zeros(self.table.shape[1])
                    for x in range(a, b, 1 << 18):
                        whole += self.table[grams[x : min(b, x + (1 << 18))]].sum(0, dtype=np.float64)
                    out[at + i] = whole / (b - a) * min(b - a, EVIDENCE)
            at += step
        return out


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, suffix, domain, host of pages. Text is the markup less tags, scripts and styles."""
    host, _ = host_and_path(F.col("url"))
    text = F.regexp_replace(F.coalesce("html", F.lit("")), _TAGS, " ")
    declared = lower_ascii(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    rows = pages.select(F.col("page_id").cast("long"), text.alias("text"), F.nullif(declared, F.lit("")).alias("declared"), host.alias("host"))
    return rows.select("*", F.nullif(F.substring_index("host", ".", -1), F.lit("")).alias("suffix"), F.substring_index("host", ".", -2).alias("domain"))


def document_evidence(docs: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), "text", none.alias("declared"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), none.alias("suffix"), F.lit("").alias("domain"))


def fit_text(evidence: DataFrame, sample: int = SAMPLE, min_texts: int = MIN_TEXTS) -> TextModel:
    """From at most ``sample`` different texts of each declared language, those with the smallest hashes. Hashes are chosen
    first, over all rows (each task passes on no more than the sample); the texts of those chosen are counted where they are,
    and only the counts reach the driver."""
    seen = evidence.where("declared IS NOT NULL").select("declared", "text", F.xxhash64("text").alias("h"))
    hashes = checkpoint(seen.select("declared", "h").distinct())
    rank = F.row_number().over(W.partitionBy("declared").orderBy("h"))
    chosen = hashes.withColumn("rank", rank).where(F.col("rank") <= max(sample, min_texts))
    enough = chosen.groupBy("declared").agg(F.max("rank").alias("n")).where(F.col("n") >= min_texts).select("declared")
    wanted = checkpoint(chosen.where(F.col("rank") <= sample).join(enough, "declared").select("declared", "h"))
    texts = seen.join(F.broadcast(wanted), ["declared", "h"], "left_semi").groupBy("declared", "h").agg(F.min("text").alias("text"))

    def count(batches):
        for b in batches:
            parts: dict[str, np.ndarray] = {}
            for lang, text in zip(b["declared"], b["text"], strict=True):
                parts[lang] = parts.get(lang, 0) + np.bincount(_codes([_clean(text)])[0], minlength=BINS).astype(np.int64)
            yield pd.DataFrame({"declared": list(parts), "n": [x.tobytes() for x in parts.values()]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"declared": part["declared"][:1], "n": [sum(np.frombuffer(x, np.int64) for x in part["n"]).tobytes()]})

    kind = "declared string, n binary"
    rows = texts.select("declared", "text").mapInPandas(count, kind).groupBy("declared").applyInPandas(add, kind).collect()
    return TextModel({r.declared: np.frombuffer(r.n, np.int64) for r in rows})


def text_posteriors(evidence: DataFrame, model: TextModel) -> DataFrame:
    """``evidence`` without text, with loglik: an array in the order of the model's languages."""
    held = evidence.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def loglik(texts: pd.Series) -> pd.Series:
        return pd.Series(list(held.value.log_likelihoods(list(texts))))

    return evidence.withColumn("loglik", loglik("text")).drop("text")


def _soft(loglik: str) -> Column:
    top = f"array_max({loglik})"
    return F.expr(f"transform(array(transform({loglik}, x -> exp(x - {top}))), e -> transform(e, x -> x / aggregate(e, 0D, (s, y) -> s + y)))[0]")


def _shares(rows: DataFrame, key: str, k: int) -> DataFrame:
    """(key, n, s0, ...): how often each language is the text's."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").cast("double").alias("n"), *(F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k)))


def _drawn(k: int, own: str, n: str, above: list[Column]) -> list[Column]:
    """Shares drawn towards those above: (count + STRENGTH * share above) / (n + STRENGTH)."""
    return [(F.coalesce(F.col(f"{own}{i}"), F.lit(0.0)) + STRENGTH * above[i]) / (F.coalesce(F.col(n), F.lit(0.0)) + STRENGTH) for i in range(k)]


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """``rows`` (loglik, declared, suffix, domain, host) with lang and confidence."""
    k = len(languages)
    rows = rows.withColumn("p", _soft("loglik"))
    whole = rows.agg(F.count("*").alias("n"), *(F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k))).first()
    base = [((whole[f"s{i}"] or 0.0) + 1.0) / ((whole["n"] or 0) + k) for i in range(k)]
    top = [F.lit(x) for x in base]

    def named(df: DataFrame, key: str, to: str) -> DataFrame:
        return df.select(F.col(key).alias(f"{to}_key"), F.col("n").alias(f"{to}_n"), *(F.col(f"s{i}").alias(f"{to}{i}") for i in range(k)))

    domains = named(_shares(rows, "domain", k), "domain", "d")
    hosts = named(_shares(rows.select("p", F.struct("domain", "host").alias("at")), "at", k), "at", "h")
    hosts = hosts.join(domains, F.col("h_key.domain") == F.col("d_key"), "left")
    prior = _drawn(k, "h", "h_n", _drawn(k, "d", "d_n", top))
    hosts = checkpoint(hosts.select(F.col("h_key.domain").alias("j_domain"), F.col("h_key.host").alias("j_host"), F.array(*(F.log(x) for x in prior)).alias("host_prior")))
    out = rows.join(F.broadcast(hosts) if small(hosts, BROADCAST_ROWS) else hosts, F.expr("domain <=> j_domain AND host <=> j_host"), "left").drop("j_domain", "j_host")
    for key in ("declared", "suffix"):  # P(value | language) over P(value)
        each = named(_shares(rows, key, k), key, key)
        weight = F.array(*(F.log(_drawn(k, key, f"{key}_n", top)[i] / top[i]) for i in range(k)))
        each = checkpoint(each.select(F.col(f"{key}_key"), weight.alias(f"{key}_weight")))
        out = out.join(F.broadcast(each) if small(each, BROADCAST_ROWS) else each, F.col(key) == F.col(f"{key}_key"), "left").drop(f"{key}_key")
    zero = F.array(*[F.lit(0.0)] * k)
    total = F.array(*(F.col("loglik")[i] + sum((F.coalesce(F.col(c), zero)[i] for c in ("declared_weight", "suffix_weight")), F.coalesce(F.col("host_prior"), F.array(*(F.log(x) for x in top)))[i]) for i in range(k)))
    out = out.withColumn("total", total).withColumn("posterior", _soft("total"))
    names = F.array(*(F.lit(x) for x in languages))
    return out.withColumn("confidence", F.array_max("posterior")).withColumn("lang", F.get(names, F.array_position("posterior", F.col("confidence")).cast("int") - 1))


def identify(evidence: DataFrame, model: TextModel) -> DataFrame:
    if not model.languages:
        return evidence.withColumn("lang", F.lit("und")).withColumn("confidence", F.lit(0.0))
    return fuse(checkpoint(text_posteriors(evidence, model)), model.languages)


def query(spark, sf_dir: str) -> DataFrame:
    pages = page_evidence(table(spark, sf_dir, "pages")).withColumn("doc_id", F.lit(None).cast("long"))
    docs = document_evidence(table(spark, sf_dir, "documents")).withColumn("page_id", F.lit(None).cast("long"))
    out = identify(pages.unionByName(docs), fit_text(pages))
    return out.select("doc_id", "page_id", "lang", F.round("confidence", 6).alias("confidence"))
