"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The index is a table of postings (term, document, position), written once to the shared folder; a document's sentinel, the
empty term at the position after its last word, holds its length. It has the lists of all terms, or of the test items' terms
only. Texts are shuffled once, by document, and the table is bucketed by document and sorted by term: lists are then
intersected where they lie, and only the places that a list is held against move, however many there are.

A test phrase is probed by its rarest terms by corpus frequency. Their lists, each moved back by the probe's place in the
phrase, are intersected on (document, start), the rarest first: of each other list only what is near a place of the one
before is kept. A proximity match is a start from which all of them stand within ``slop`` words of where the phrase has them,
in any order. Where they meet at one start, the phrase is compared word for word with the document, so that exact matches are
exact.

Frequencies are counted over all postings; a phrase with a term that no document has is dropped, as it cannot occur.
Terms and phrases come from the benchmark, not from the corpus: they are broadcast if there are at most ``BROADCAST_ROWS``
of them, each counted by itself, and else joined by shuffles that adaptive execution splits at hot terms. Documents with
candidates are fetched in the same two ways.

Cases: null or empty texts have no words and match nothing; items without words have no phrase; the windows of an item with
a null id hit like any other, but add no name to a document's items; windows that several items share name them all; rows
that share doc_id are told apart by a hash of their text, and rows repeated in full each get the same result; texts of any
length are read whole; empty tables give no rows, or no hits; other columns, whatever their names, are ignored by
``decontaminate`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evoked.llm.common import checkpoint, hinted, lower_ascii, remove, setting, settled, shared_dir, small, table

WINDOW = 10
#: Rarest terms of a phrase whose posting lists are intersected, where only exact and where also proximity matches are asked for.
PROBES, NEAR_PROBES = 2, 3
#: Words by which a probe may stand off its place in a proximity match.
SLOP = 4
#: At most so many rows are broadcast: some 50 MB.
BROADCAST_ROWS = 400_000
#: All of ASCII but 0-9 and a-z, after lower-casing.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ROW = ("doc_id", "row_hash")


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NON_WORD), "")


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(phrase_id, phrase, n, items): each distinct run of ``window`` words of an item, or the whole of a shorter item."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    runs = w.select("item", F.expr(f"explode(transform(sequence(0, greatest(size(w) - {window}, 0)), i -> slice(w, i + 1, {window})))").alias("phrase"))
    found = runs.groupBy("phrase").agg(F.collect_set("item").alias("items"))
    return found.select(F.xxhash64("phrase").alias("phrase_id"), "phrase", F.size("phrase").alias("n"), "items")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("row_hash"), text.alias("text"))


def build(docs: DataFrame, terms: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """The index of ``docs``, written to ``path`` (a new folder in the shared one, if unset) and read again. ``terms`` (term):
    the lists to keep, besides the sentinels; all, if unset. ``key``, a hash of both names of a document, is what it is bucketed
    by. The catalog's entry serves to read it as such and is dropped again; the files stay."""
    spark, name = docs.sparkSession, f"evoked_index_{uuid.uuid4().hex}"
    path = path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _rows(docs).withColumn("key", F.xxhash64(*ROW)).repartition(buckets, "key")
    postings = rows.select("key", *ROW, F.posexplode(F.array_append(words(F.col("text")), F.lit(""))).alias("pos", "term"))
    if terms is not None:
        kept = checkpoint(terms.unionByName(spark.range(1).select(F.lit("").alias("term"))).distinct())
        postings = postings.join(hinted(kept, BROADCAST_ROWS), "term", "left_semi")
    postings.select("term", "key", *ROW, "pos").write.format("parquet").bucketBy(buckets, "key").sortBy("term").option("path", path).saveAsTable(name)
    index = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return index


def lengths(index: DataFrame) -> DataFrame:
    """(doc_id, row_hash, n_words), a row for each row of the indexed table."""
    return index.where("term = ''").select(*ROW, F.col("pos").cast("long").alias("n_words"))


def probes(index: DataFrame, ph: DataFrame, n_probes: int = NEAR_PROBES) -> DataFrame:
    """(term, phrase_id, at, need, rank): the places ``at`` of each phrase's rarest terms, ``need`` of them: ``n_probes``, or all."""
    places = ph.select("phrase_id", "n", F.posexplode("phrase").alias("at", "term"))
    freq = index.where("term <> ''").groupBy("term").agg(F.count("*").alias("freq"))
    known = places.join(checkpoint(freq), "term").groupBy("phrase_id", "n").agg(F.array_sort(F.collect_list(F.struct("freq", "at", "term"))).alias("p"))
    known = known.where("size(p) = n").select("phrase_id", F.least("n", F.lit(n_probes)).alias("need"), F.posexplode(F.slice("p", 1, n_probes)).alias("rank", "p"))
    return known.select("p.term", "phrase_id", "p.at", "need", "rank")


def moved_lists(index: DataFrame, pr: DataFrame) -> DataFrame:
    """(key, doc_id, row_hash, phrase_id, at, need, start): the probes' lists, moved back by the probes' places. need: how many
    probes the phrase has."""
    uses = checkpoint(pr.groupBy("term").agg(F.collect_list(F.struct("phrase_id", "at", "need")).alias("uses")))
    lists = index.join(hinted(uses, BROADCAST_ROWS), "term").select("key", *ROW, "pos", F.inline("uses"))
    return lists.select("key", *ROW, "phrase_id", "at", "need", (F.col("pos") - F.col("at")).alias("start"))


def met_lists(index: DataFrame, pr: DataFrame, slop: int = SLOP, n_probes: int = NEAR_PROBES) -> DataFrame:
    """(doc_id, row_hash, phrase_id, start, whole): starts from which all probes of a phrase stand near where the phrase would
    have them: their moved-back places lie within ``slop`` words after ``start``, in any order. whole: they are at ``start``.
    Of each further list, only what is near a place of the list before is kept."""
    bucket = F.floor(F.col("start") / (slop + 1))
    lists = part = checkpoint(moved_lists(index, pr.where("rank = 0")))
    for rank in range(1, n_probes):
        near = checkpoint(part.select("key", "phrase_id", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket")).distinct())
        part = moved_lists(index, pr.where(F.col("rank") == rank)).withColumn("bucket", bucket)
        # Buckets of documents are enough to join by document, phrase and place: the index stays where it is.
        with setting(index.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
            part = settled(part.join(hinted(near, BROADCAST_ROWS), ["key", "phrase_id", "bucket"], "left_semi").drop("bucket"))
        lists = lists.unionByName(part.select(lists.columns))
    after = W.partitionBy(*ROW, "phrase_id").orderBy("start")
    seen = lambda end: F.size(F.collect_set("at").over(after.rangeBetween(0, end)))
    near = lists.withColumn("k", seen(slop)).where("k >= need").withColumn("whole", seen(0) >= F.col("need"))
    return near.groupBy(*ROW, "phrase_id", "start").agg(F.bool_or("whole").alias("whole"))


def exact_matches(docs: DataFrame, met: DataFrame, ph: DataFrame) -> DataFrame:
    """One row for each different row of ``docs`` with a match: doc_id, row_hash, and matches: (start, n, items) of each."""
    met = met.where("whole AND start >= 0").select(*ROW, "phrase_id", "start")
    met = met.join(hinted(ph, BROADCAST_ROWS // 10), "phrase_id").groupBy(*ROW).agg(F.collect_list(F.struct("start", "n", "phrase", "items")).alias("found"))
    met = checkpoint(met)
    there = _rows(docs)
    if small(met, BROADCAST_ROWS):
        there = there.join(F.broadcast(met.select(*(F.col(c).alias(f"m_{c}") for c in ROW))), F.expr("doc_id <=> m_doc_id AND row_hash = m_row_hash"), "left_semi")
    there = there.dropDuplicates(list(ROW))
    other = met.select(*(F.col(c).alias(f"m_{c}") for c in ROW), "found")
    both = there.join(other, F.expr("doc_id <=> m_doc_id AND row_hash = m_row_hash"))
    # The words are bound by an outer lambda, or else they would be split again for each candidate.
    equal = F.transform(F.array(words(F.col("text"))), lambda w: F.filter("found", lambda m: F.slice(w, m.start + 1, m.n) == m.phrase))
    exact = both.select(*ROW, equal[0].alias("found")).where("size(found) > 0")
    return exact.select(*ROW, F.expr("transform(found, m -> struct(m.start, m.n, m.items))").alias("matches"))


def _looked_up(docs: DataFrame, items: DataFrame, window: int, slop: int, n_probes: int, path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index, the phrases, and where the probes' lists meet."""
    ph = checkpoint(phrases(items, window))
    index = build(docs, ph.select(F.explode("phrase").alias("term")).distinct(), path)
    return index, ph, checkpoint(met_lists(index, checkpoint(probes(index, ph, n_probes)), slop, n_probes))


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, n_probes: int = PROBES, path: str | None = None) -> DataFrame:
    _, ph, met = _looked_up(docs, items, window, 0, n_probes, path)
    return exact_matches(docs, met, ph)


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = SLOP, window: int = WINDOW, n_probes: int = NEAR_PROBES) -> DataFrame:
    """(doc_id, row_hash, phrase_id, start)."""
    return _looked_up(docs, items, window, slop, n_probes)[2].drop("whole")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Each row's doc_id, row_hash, n_words, n_hit (words inside a match), items (sorted), contaminated and near_items
    (items with a proximity match, sorted)."""
    index, ph, met = _looked_up(docs, items, window, slop, NEAR_PROBES)
    names = lambda c: F.array_sort(F.array_distinct(F.flatten(c)))
    hits = exact_matches(docs, met, ph).select(
        *(F.col(c).alias(f"m_{c}") for c in ROW),
        F.expr("size(array_distinct(flatten(transform(matches, m -> sequence(m.start, m.start + m.n - 1)))))").alias("n_hit"), names(F.col("matches.items")).alias("items"),
    )
    near = met.select(*ROW, "phrase_id").distinct().join(hinted(ph.select("phrase_id", "items"), BROADCAST_ROWS // 10), "phrase_id")
    near = near.groupBy(*(F.col(c).alias(f"p_{c}") for c in ROW)).agg(names(F.collect_list("items")).alias("near_items"))
    out = lengths(index).join(hits, F.expr("doc_id <=> m_doc_id AND row_hash = m_row_hash"), "left").join(near, F.expr("doc_id <=> p_doc_id AND row_hash = p_row_hash"), "left")
    n_hit, none = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long"), F.expr("cast(array() AS array<string>)")
    return out.select(*ROW, "n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), (n_hit > 0).alias("contaminated"), F.coalesce("near_items", none).alias("near_items"))


def query(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_items, digest = F.size("items").cast("long"), F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), digest.alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any exact match, whole."""
    path = f"{shared_dir(docs.sparkSession)}/index-{uuid.uuid4().hex}"
    bad = checkpoint(phrase_matches(docs, items, path=path).select(F.col("doc_id").alias("_m_doc_id"), F.col("row_hash").alias("_m_row_hash")))
    remove(docs.sparkSession, path)
    here = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(hinted(bad, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("_m_doc_id")) & (here == F.col("_m_row_hash")), "left_anti")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
starts AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
wins AS MATERIALIZED (SELECT DISTINCT item, w[i:i + 9] AS ws, array_to_string(w[i:i + 9], ' ') AS phrase, least(len(w), 10) AS n FROM starts),
runs AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n),
hit AS (SELECT doc_id, item, i, runs.n FROM runs JOIN wins ON runs.n = wins.n AND array_to_string(w[i:i + runs.n - 1], ' ') = phrase),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit WHERE item IS NOT NULL) GROUP BY doc_id),
places AS (SELECT DISTINCT phrase, n, i - 1 AS o, ws[i] AS t FROM (SELECT phrase, n, ws, unnest(range(1, n + 1)) AS i FROM wins)),
tok AS MATERIALIZED (SELECT doc_id, i - 1 AS pos, w[i] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i] IN (SELECT t FROM places)),
freq AS (SELECT t, count(*) AS f FROM tok GROUP BY t),
pr AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY f, o) AS rk, count(f) OVER (PARTITION BY phrase) AS known FROM places LEFT JOIN freq USING (t)),
mv AS MATERIALIZED (SELECT doc_id, phrase, n, o, pos - o AS s FROM tok JOIN (SELECT * FROM pr WHERE known = n AND rk <= {NEAR_PROBES}) p USING (t)),
nr AS (SELECT DISTINCT doc_id, phrase FROM (SELECT a.doc_id, a.phrase, a.s, a.n FROM mv a JOIN mv b ON a.doc_id = b.doc_id AND a.phrase = b.phrase AND b.s BETWEEN a.s AND a.s + {SLOP}
       GROUP BY ALL HAVING count(DISTINCT b.o) >= least(a.n, {NEAR_PROBES}))),
nit AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM nr JOIN wins USING (phrase) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nit USING (doc_id)
"""
