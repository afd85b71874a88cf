"""Quality rules with thresholds from mergeable quantile sketches per language and source.

A sketch counts values in buckets whose bounds grow by a fixed ratio (``RATIO``), so that quantiles are right within
that ratio. It is a plain grouped count: sketches merge by adding, in any order, and the thresholds are the same however
rows are dealt out. Groups are counted map-side, so a source with a third of all rows moves no more than any other.

For each metric a group's upper limit is q75 + FENCE * max(q75 - q25, least), and its lower limit is the mirror of that:
documents far outside their own language and source go, whatever is usual elsewhere. Groups of fewer than ``MIN_GROUP``
documents take the limits of their language, and languages as small those of all rows. Limits are joined to the rows;
there are as many as groups, and Spark chooses the join.

Cases: null texts have no words and fail the base rules; null languages and sources are groups of their own; empty
tables give no rows; rows that are repeated are judged each by itself; extra columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evoked.llm.common import checkpoint, table

RATIO, FENCE, MIN_GROUP = 1.02, 8.0, 30
#: Name: (value of a document's base counts, least spread).
METRICS = {
    "word_length": ("word_chars / greatest(n_words, 1)", 0.25),
    "symbol_share": ("n_symbols / greatest(n_words, 1)", 0.02),
    "dup_line_share": ("n_dup_lines / greatest(n_lines, 1)", 0.05),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", 0.04),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


def counts(text: str | None) -> tuple[int, ...]:
    """The base counts of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    # Code points are all bytes but those that continue one.
    chars = len(text or "") - (len(raw) - len(raw.translate(None, _SPACE)))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    repeated = 0
    if n > 3:
        triples = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(triples)) < len(triples):
            first: dict = {}
            inside = bytearray(n)
            for i, t in enumerate(triples):
                j = first.setdefault(t, i)
                if j != i:
                    inside[i : i + 3] = inside[j : j + 3] = b"\1\1\1"
            repeated = sum(inside)
    return n, chars, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts."""

    def make(batches):
        for b in batches:
            rows = [counts(t) for t in b["text"]]
            out = pd.DataFrame(rows, columns=COUNTS, dtype="int64")
            yield pd.concat([pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "lang": b["lang"], "source": b["source"]}).reset_index(drop=True), out], axis=1)

    kind = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInPandas(make, kind)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) of the documents that pass the base rules. Bucket 0 holds values under 1e-6."""
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.expr(v).cast("double").alias("x")) for m, (v, _) in METRICS.items()))
    bucket = F.when(F.col("x") < 1e-6, 0).otherwise(F.floor(F.log(F.col("x") / 1e-6) / F.log(F.lit(RATIO))) + 1).cast("int")
    rows = measured.where(~base_failed()).select("lang", "source", F.inline(each))
    return rows.groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, docs, q25, q75): a bucket's value is its geometric middle."""
    w = W.partitionBy(*keys, "metric")
    run = sketches.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("docs", F.sum("n").over(w))
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(1e-6 * F.pow(F.lit(RATIO), F.col("bucket") - 0.5))
    q = lambda p: F.min(F.when(F.col("upto") >= p * F.col("docs"), F.struct("bucket", value.alias("v"))))["v"]
    return run.groupBy(*keys, "metric").agg(F.max("docs").alias("docs"), q(0.25).alias("q25"), q(0.75).alias("q75"))


def limits(sketches: DataFrame) -> DataFrame:
    """(lang, source, one struct (lo, hi) for each metric), by group, else by language, else over all."""
    own = quantiles(merge(sketches, "lang", "source"), "lang", "source")
    lang = quantiles(merge(sketches, "lang"), "lang").select(F.col("lang").alias("l_lang"), F.col("metric").alias("l_metric"), *(F.col(c).alias(f"l_{c}") for c in ("docs", "q25", "q75")))
    whole = quantiles(merge(sketches)).select(F.col("metric").alias("w_metric"), F.col("q25").alias("w_q25"), F.col("q75").alias("w_q75"))
    both = own.join(lang, F.expr("lang <=> l_lang AND metric = l_metric")).join(whole, F.expr("metric = w_metric"))
    pick = lambda c: F.when(F.col("docs") >= MIN_GROUP, F.col(c)).when(F.col("l_docs") >= MIN_GROUP, F.col(f"l_{c}")).otherwise(F.col(f"w_{c}"))
    both = both.select("lang", "source", "metric", pick("q25").alias("q25"), pick("q75").alias("q75"))
    least = F.create_map(*(F.lit(x) for m, (_, s) in METRICS.items() for x in (m, s)))
    spread = F.lit(FENCE) * F.greatest(F.col("q75") - F.col("q25"), least[F.col("metric")])
    ranged = both.select("lang", "source", "metric", F.struct((F.col("q25") - spread).alias("lo"), (F.col("q75") + spread).alias("hi")).alias("r"))
    return ranged.groupBy("lang", "source").agg(*(F.max(F.when(F.col("metric") == m, F.col("r"))).alias(m) for m in METRICS))


def judge(docs: DataFrame) -> DataFrame:
    """The base counts, base_failed, kept and the names of the metrics outside their limits (failed)."""
    measured = checkpoint(measure(docs))
    edges = limits(checkpoint(sketch(measured)))
    edges = edges.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *METRICS)
    out = measured.join(edges, F.expr("lang <=> g_lang AND source <=> g_source"), "left").withColumn("base_failed", base_failed())
    outside = [F.when(~F.col("base_failed") & ~F.coalesce(F.expr(v).between(F.col(m).lo, F.col(m).hi), F.lit(True)), F.lit(m)) for m, (v, _) in METRICS.items()]
    out = out.withColumn("failed", F.array_compact(F.array(*outside)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def query(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept")
