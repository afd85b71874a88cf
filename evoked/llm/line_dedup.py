"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Two lines are near if one insertion, deletion or substitution of a character turns one into the other. Each line's
variants with one character deleted are hashed; lines that share a variant meet, are verified with ``levenshtein``, and
all but the earliest go. A substitution is one variant (same place, same length) in two lines; an insertion is a variant
of one line that equals another whole line. So a line has to be compared only with the earliest of its meeting, and no
meeting is expanded into pairs; no meeting has more lines than there are places and characters to put there.

Emitting every variant of every line would multiply the corpus by the length of its lines. Two exact filters come first,
each by the pigeonhole principle: if one edit is inside one half of a line, the other half is intact; and if it is
inside one block of ``BLOCK`` characters, all before and all after the block are intact. Only blocks that another line
shares the surroundings of emit variants. No line that has a near one is lost by this. Halves and surroundings that many
lines share are found by grouped aggregation, which adds up before it shuffles, and joined back.

A line is dropped if an equal or a near line stands earlier: in a smaller doc_id, or further up in the same text. All lines but
empty ones have equal lines; lines of fewer than ``MIN_CHARS`` characters have no near ones, as one edit makes another word
of them. A line that makes up a large share of all repeated ones (at most ``DEALT`` can) is dealt over ``SALTS`` keys.

Cases: null texts stay null and have no lines; empty texts are one empty line, which is kept, as all empty lines are; texts
and lines of any length are read whole; equal lines are dropped but for the first, ties cannot be, as no two lines stand at one
place; rows with equal doc_id and text count as one document and get the same result; rows that share doc_id with other texts
are told apart by a hash of the text; null doc_ids come first; empty tables give empty results; the columns of the input stay,
whatever their names, but for those named _n_lines and _n_dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evoked.llm.common import checkpoint, hinted, packed, small, table, unpacked

MIN_CHARS = 16
BLOCK = 32
#: At most so many line hashes are broadcast: some 50 MB.
BROADCAST_ROWS = 600_000
#: A line with more than one in DEALT of all repeated lines is dealt over SALTS keys.
DEALT, SALTS = 2000, 64
H = ("h1", "h2")
#: Where a line stands; the order of these is that of lines.
AT = ("doc_id", "text_hash", "pos")


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, pos, line, h1, h2) of the lines that take part."""
    at = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.length("line") >= min_chars)
    return at.select("*", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def _halves() -> Column:
    """Hashes of the halves of ``line``, cut as for a line of its own length and for one that is shorter by one."""
    n = F.length("line")
    keys = []
    for c in (n, n - 1):
        p = F.floor(c / 2).cast("int")
        keys += [F.xxhash64(F.lit("p"), c, F.left("line", p)), F.xxhash64(F.lit("s"), c, F.right("line", c - p))]
    return F.array(*keys)


def _with_shared_halves(lines: DataFrame) -> DataFrame:
    """The distinct lines that share an intact half with another line of the same length, or one more or less, and where each
    stands first."""
    each = lines.select("h1", F.explode(_halves()).alias("key"))
    shared = checkpoint(each.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key"))
    if small(shared, BROADCAST_ROWS):
        found = lines.select("*", F.explode(_halves()).alias("key")).join(F.broadcast(shared), "key", "left_semi")
    else:
        some = checkpoint(each.join(shared, "key", "left_semi").select("h1").distinct())
        found = lines.join(hinted(some, BROADCAST_ROWS), "h1", "left_semi")
    return found.groupBy(*H, "line").agg(F.min(F.struct(*AT)).alias("at")).select(*H, "line", "at.*")


def _block_keys(c: DataFrame, block: int) -> DataFrame:
    """For each line and block: the part inside the block and a hash of all outside it. role s: against lines of the same
    length; d: against lines shorter by one; c: the shorter line's own."""
    b = c.select(*AT, "line", F.length("line").alias("n"), F.explode(F.expr(f"sequence(0, cast(floor(length(line) / {block}) AS int))")).alias("b"))
    b = b.withColumn("at", F.expr(f"b * {block}")).withColumn("before", F.expr("xxhash64(left(line, at))"))
    after = f"xxhash64(substring(line, at + {block} + 1))"
    own = f"xxhash64(substring(line, at + {block}))"
    roles = f"""array(
        struct('s' AS role, xxhash64('s', n, b, before, {after}) AS around, substring(line, at + 1, {block}) AS part),
        struct('d' AS role, xxhash64('d', n - 1, b, before, {after}) AS around, substring(line, at + 1, {block}) AS part),
        struct('c' AS role, xxhash64('d', n, b, before, {own}) AS around, substring(line, at + 1, {block} - 1) AS part))"""
    return b.select(F.struct(*AT).alias("rank"), F.expr(f"inline({roles})")).where("role = 'c' OR part <> ''")


def near_lines(docs: DataFrame, min_chars: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """(h1, h2) of the distinct lines to which an earlier line is near."""
    first = checkpoint(_with_shared_halves(_lines(docs, min_chars)))
    blocks = _block_keys(first, block)
    shared = checkpoint(blocks.groupBy("around").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).where("lo <> hi").select("around"))
    blocks = blocks.join(hinted(shared, BROADCAST_ROWS), "around", "left_semi")
    variants = F.expr("""CASE role
        WHEN 'c' THEN array(xxhash64(around, part))
        WHEN 'd' THEN transform(sequence(1, length(part)), j -> xxhash64(around, concat(left(part, j - 1), substring(part, j + 1))))
        ELSE transform(sequence(1, length(part)), j -> xxhash64(around, j, concat(left(part, j - 1), substring(part, j + 1)))) END""")
    keyed = blocks.select("rank", "role", F.explode(variants).alias("variant"))
    same = W.partitionBy("variant")
    earliest = lambda role: F.min(F.when(F.col("role") == role, F.col("rank"))).over(same)
    keyed = keyed.withColumns({r: earliest(r) for r in "sdc"})
    best = F.when(F.col("role") == "s", F.col("s")).when(F.col("role") == "d", F.col("c")).otherwise(F.col("d"))
    pairs = keyed.select("rank", best.alias("best")).where("best < rank").distinct()
    text = first.select(F.struct(*AT).alias("rank"), *H, "line")
    both = pairs.join(text, "rank").join(text.select(F.col("rank").alias("best"), F.col("line").alias("other")), "best")
    return both.where(F.levenshtein("line", "other", 1) >= 0).select(*H).distinct()


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, drop): for each document that loses lines, the (pos, h1) of those."""
    near = checkpoint(near_lines(docs, min_chars, block).withColumn("near", F.lit(True)))
    lines = _lines(docs, 1).select(*AT, *H)
    each = lines.groupBy(*H).agg(F.min(F.struct(*AT)).alias("kept"), F.count("*").alias("n"))
    losing = checkpoint(each.join(hinted(near, BROADCAST_ROWS), list(H), "left").where("n > 1 OR near").select(*H, "kept", "near", "n"))
    if small(losing, BROADCAST_ROWS):
        met = lines.join(F.broadcast(losing), list(H))
    else:
        whole = losing.agg(F.sum("n")).first()[0]
        heavy = F.col("n") * DEALT > whole
        salts = losing.withColumn("salt", F.explode(F.when(heavy, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
        dealt = lines.join(F.broadcast(losing.where(heavy).select(*H, F.lit(SALTS).alias("keys"))), list(H), "left")
        met = dealt.withColumn("salt", F.pmod(F.xxhash64(*AT), F.coalesce("keys", F.lit(1)))).join(salts, [*H, "salt"])
    gone = met.where(F.col("near") | (F.col("kept") != F.struct(*AT)))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("pos", "h1")).alias("drop"))


def _kept(text: Column, drop: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line, i: drop.isNull() | ~F.array_contains(drop, F.struct(i.alias("pos"), F.xxhash64(line).alias("h1"))))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """``docs`` with the dropped lines taken out of text, and the counts _n_lines and _n_dropped."""
    gone = dropped_lines(docs.select("doc_id", "text"), min_chars, block).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    rows = packed(docs, F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("text_hash"))
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    out = out.select("_row", "text", n.alias("n"), _kept(F.col("text"), F.col("drop")).alias("left"))
    dropped = F.when(F.col("text").isNull(), 0).otherwise(F.col("n") - F.size("left")).cast("long")
    text = F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.array_join("left", "\n"))
    return unpacked(out, docs.columns, F.col("n").alias("_n_lines"), dropped.alias("_n_dropped"), names=("_n_lines", "_n_dropped"), text=text)


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


#: One edit apart: what two lines have in common at their ends covers all but one character of the longer.
SQL = f"""
WITH l AS MATERIALIZED (SELECT doc_id, i - 1 AS pos, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i
                        FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))),
f AS MATERIALIZED (SELECT line, min(struct_pack(d := doc_id, p := pos)) AS st, length(line) AS n FROM l WHERE length(line) >= {MIN_CHARS} GROUP BY line),
g AS MATERIALIZED (SELECT line, min(struct_pack(d := doc_id, p := pos)) AS st FROM l WHERE line <> '' GROUP BY line),
k AS MATERIALIZED (SELECT line, st, c, 'p' || left(line, c // 2) AS key FROM f, (VALUES (0), (1)) v(o), LATERAL (SELECT n - o AS c)
     UNION ALL SELECT line, st, c, 's' || right(line, c - c // 2) FROM f, (VALUES (0), (1)) v(o), LATERAL (SELECT n - o AS c)),
near AS (SELECT DISTINCT b.line FROM k a JOIN k b ON a.c = b.c AND a.key = b.key AND a.st < b.st WHERE levenshtein(a.line, b.line) <= 1),
kept AS (SELECT l.doc_id, l.pos, l.line FROM l LEFT JOIN g USING (line) LEFT JOIN near ON near.line = l.line
         WHERE l.line = '' OR (near.line IS NULL AND g.st = struct_pack(d := l.doc_id, p := l.pos))),
t AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS text FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines, coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(t.n, 0) AS n_dropped,
       length(coalesce(t.text, '')) AS kept_chars, sha256(coalesce(t.text, '')) AS kept_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""
