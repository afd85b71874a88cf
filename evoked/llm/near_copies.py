"""Near copies by SimHash and an exact similarity join on word shingles: every pair of documents whose sets of five-word
shingles have a Jaccard similarity of 0.8 or more is linked, directly or by others, and no other pair is.

No fingerprint distance covers such pairs, so SimHash comes first and is not the whole: deletion-variant signatures
(``simhash.links``) bring the closest copies together, which are verified by their sets; a prefix filter finds the rest.

Shingles are hashed to 64 bits; documents with equal sets are one node. A pair at 0.8 shares at least 0.8 of either set, so
with the shingles of each set in one order for all, rarest first, its smallest common shingle stands among the first
``shared - ceil(0.8 n) + 1`` of both (prefix filter). Shingles that only one document has are never common and are left
out after counting; a document with too few others is near nothing.

Documents that meet at a shingle are verified by their sets. Meetings of more than ``MEETING`` are not expanded into pairs:
each of them is first verified against the smallest one, and then only those still in different components are compared,
less the ones whose shingles, counted in buckets, differ too much for the threshold (a lower bound on the difference).

Cases: null and empty texts are equal; fewer words than a shingle: the whole sequence is one shingle; texts of any length are
read whole; rows are told apart by doc_id and a hash of the text, so rows that share doc_id, or have none, are documents like
any other; of a group the smallest (doc_id, hash) stays, ids before nulls, and one of rows repeated in full; empty tables give
no rows; other columns, whatever their names, are kept by ``drop_copies`` and ignored by the rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoked.llm.common import checkpoint, hinted, packed, settled, small, unpacked
from evoked.llm.simhash import SEED, components, links, majority, spans

#: Bits in which the fingerprints of what SimHash links may differ.
DISTANCE = 4
#: Meetings of up to so many documents are compared pair by pair.
MEETING = 16
BUCKETS = 128
#: Rows that leave a Python worker at a time.
CHUNK = 500_000
BROADCAST_ROWS = 500_000


def shingles(text: str | None, size: int) -> np.ndarray:
    """The set's hashes, ascending."""
    joined, at = spans(text, size)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in at), np.uint64, len(at)).view(np.int64))


def _node(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _nodes(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_hash, node, f): documents with equal sets have one node; f: the set's SimHash."""

    def make(batches):
        for b in batches:
            sets = [shingles(t, size) for t in b["text"]]
            f = np.array([majority([h.view(np.uint64)]) for h in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text_hash": b["text_hash"], "node": np.array([_node(h) for h in sets], np.int64), "f": f})

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return rows.mapInPandas(make, "doc_id long, text_hash long, node long, f long")


def _rows(docs: DataFrame, size: int) -> DataFrame:
    """(h, node, n): a row for each shingle of each document, n the size of its set."""

    def frame(parts):
        each = [len(h) for _, h in parts]
        return pd.DataFrame({"h": np.concatenate([h for _, h in parts]), "node": np.repeat(np.array([x for x, _ in parts], np.int64), each), "n": np.repeat(np.array(each, np.int32), each)})

    def make(batches):
        for b in batches:
            parts, held = [], 0
            for t in b["text"]:
                h = shingles(t, size)
                parts.append((_node(h), h))
                held += len(h)
                if held > CHUNK:
                    yield frame(parts)
                    parts, held = [], 0
            if parts:
                yield frame(parts)

    return docs.select("text").mapInPandas(make, "h long, node long, n int")


def _runs(batches, cols: list[str], by: str):
    """Columns of rows sorted by ``by``, cut so that no run of equal values is parted; and the edges of the runs."""
    held: list[tuple] = []

    def done(parts):
        whole = [np.concatenate(x) for x in zip(*parts, strict=True)]
        key = whole[cols.index(by)]
        return whole, np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))

    for batch in batches:
        if not len(batch):
            continue
        part = tuple(batch[c].to_numpy() for c in cols)
        key = part[cols.index(by)]
        cut = int(np.searchsorted(key, key[-1]))
        if cut or held and held[-1][cols.index(by)][-1] != key[-1]:
            yield done([*held, tuple(x[:cut] for x in part)])
            held = []
        held.append(tuple(x[cut:].copy() for x in part))
    if held:
        yield done(held)


def _candidates(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(node, n, p, hs): for nodes that can be near another, their shingles that others have too, rarest first, of which the
    first p are the prefix."""

    def common(batches):
        for (h, node, n), _ in _runs(batches, ["h", "node", "n"], "h"):
            if not len(h):
                continue
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])))
            h, node, n = h[new], node[new], n[new]
            edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
            df = np.repeat(np.diff(edge), np.diff(edge))
            yield pd.DataFrame({"h": h, "node": node, "n": n, "df": df})[df > 1]

    def prefix(batches):
        for (node, n, h), edge in _runs(batches, ["node", "n", "h"], "node"):
            out = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                p = b - a - -(-num * int(n[a]) // den) + 1
                if p > 0:
                    out.append((node[a], n[a], p, h[a:b]))
            if out:
                yield pd.DataFrame(out, columns=["node", "n", "p", "hs"])

    rows = _rows(docs, size).repartition("h").sortWithinPartitions("h", "node").mapInPandas(common, "h long, node long, n int, df long")
    rows = rows.repartition("node").sortWithinPartitions("node", "df", "h").select("node", "n", "h")
    return rows.mapInPandas(prefix, "node long, n int, p int, hs array<long>")


def _meetings(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode(F.expr("slice(hs, 1, p)")).alias("key"), "node", "n")


def _first_pairs(keyed: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): all pairs of small meetings, and of others each node with the smallest one."""

    def meet(batches):
        for (key, node, n), edge in _runs(batches, ["key", "node", "n"], "key"):
            if not len(key):
                continue
            count = np.diff(edge)
            first, few = np.repeat(edge[:-1], count), np.repeat(count <= MEETING, count)
            x, y = [np.flatnonzero(~few)], [first[~few]]
            at = np.flatnonzero(few)
            for lag in range(1, MEETING):
                at = at[at + lag < len(key)]
                at = at[first[at] == first[at + lag]]
                if not len(at):
                    break
                x.append(at + lag)
                y.append(at)
            x, y = np.concatenate(x), np.concatenate(y)
            fit = (x != y) & (np.minimum(n[x], n[y]).astype(np.int64) * den >= np.maximum(n[x], n[y]).astype(np.int64) * num)
            yield pd.DataFrame({"a": np.maximum(node[x], node[y])[fit], "b": np.minimum(node[x], node[y])[fit]}).drop_duplicates()

    return keyed.repartition("key").sortWithinPartitions("key", "node").mapInPandas(meet, "a long, b long").distinct()


def _rooted(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    return keyed.join(hinted(roots, BROADCAST_ROWS), "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))


def _mixed(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, n, root): large meetings that have more than one component."""

    def unlike(batches):
        for (key, node, n, root), edge in _runs(batches, ["key", "node", "n", "root"], "key"):
            if not len(key):
                continue
            count = np.diff(edge)
            differ = np.maximum.reduceat(root, edge[:-1]) != np.minimum.reduceat(root, edge[:-1])
            keep = np.repeat((count > MEETING) & differ, count)
            yield pd.DataFrame({"key": key, "node": node, "n": n, "root": root})[keep]

    return _rooted(keyed, roots).repartition("key").sortWithinPartitions("key").mapInPandas(unlike, "key long, node long, n int, root long")


def _other_pairs(mixed: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs of a meeting in different components that sizes and bucket counts do not rule out."""

    def count(batches):
        for b in batches:
            sketch = [np.minimum(np.bincount(np.asarray(h, np.int64) & (BUCKETS - 1), minlength=BUCKETS), 255).astype(np.uint8).tobytes() for h in b["hs"]]
            yield pd.DataFrame({"node": b["node"], "sketch": sketch})

    def meet(batches):
        for (key, node, n, root, sketch), edge in _runs(batches, ["key", "node", "n", "root", "sketch"], "key"):
            n = n.astype(np.int64)
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                counts = np.frombuffer(b"".join(sketch[s:e]), np.uint8).reshape(e - s, BUCKETS).astype(np.int16)
                for i in range(s, e - 1):
                    last = s + int(np.searchsorted(n[s:e], n[i] * den // num, "right"))
                    j = np.arange(i + 1, last)
                    j = j[root[j] != root[i]]
                    if len(j):
                        apart = np.abs(counts[j - s] - counts[i - s]).sum(1, dtype=np.int64)
                        j = j[apart * (den + num) <= (n[i] + n[j]) * (den - num)]
                    if len(j):
                        yield pd.DataFrame({"a": np.maximum(node[i], node[j]), "b": np.minimum(node[i], node[j])})

    sketches = sets.join(mixed.select("node").distinct(), "node", "left_semi").select("node", "hs").mapInPandas(count, "node long, sketch binary")
    rows = mixed.join(sketches, "node").select("key", "node", "n", "root", "sketch")
    return rows.repartition("key").sortWithinPartitions("key", "n").mapInPandas(meet, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sets are alike by at least num / den. Shingles that one document alone has are in n only."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("hs").alias(f"h_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(F.expr(f"size(array_intersect(h_a, h_b)) * {den + num}L >= (n_a + n_b) * {num}L")).select("a", "b")


def near_groups(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, text_hash, component_id, stays), a row for each different (doc_id, text): the smallest doc_id connected by pairs
    with a similarity of num / den or more, and whether the row is the one of its group that stays."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    nodes = checkpoint(_nodes(docs, size))
    sets = settled(_candidates(docs, size, num, den))
    close = settled(_verified(links(nodes.select("node", "f").distinct(), DISTANCE), sets, num, den))
    keyed = checkpoint(_meetings(sets))
    found = close.unionByName(settled(_verified(_first_pairs(keyed, num, den), sets, num, den)))
    roots = components(found)
    mixed = checkpoint(_mixed(keyed, roots))
    if not mixed.isEmpty():
        more = checkpoint(_verified(_other_pairs(mixed, sets, num, den), sets, num, den))
        roots = components(found.unionByName(more))
    named = nodes.join(hinted(roots, BROADCAST_ROWS), "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root")).distinct()
    named = checkpoint(named.select("root", "doc_id", "text_hash", F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("i"), F.col("doc_id").isNull().alias("none"), F.col("text_hash").alias("t")).alias("rank")))
    least = checkpoint(named.groupBy("root").agg(F.min("rank").alias("least"), F.min("doc_id").alias("component_id"), F.count("*").alias("k")).where("k > 1").drop("k"))
    out = named.join(hinted(least, BROADCAST_ROWS), "root", "left")
    return out.select("doc_id", "text_hash", F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce(F.col("rank") == F.col("least"), F.lit(True)).alias("stays"))


def drop_copies(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that stay: one of each group."""
    groups = checkpoint(near_groups(docs, size, num, den))
    gone = checkpoint(groups.where("NOT stays").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    rows = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    kept = rows.join(hinted(gone, BROADCAST_ROWS), same, "left_anti")
    # Rows are rarely repeated in full; those alone are moved to leave one of each.
    ids = rows.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("k")).where("k > 1").drop("k")
    again = checkpoint(ids)
    if not again.isEmpty():
        again = hinted(again, BROADCAST_ROWS)
        once = kept.join(again, same, "left_semi").groupBy("doc_id", "text_hash").agg(F.min("_row").alias("_row")).select("_row")
        kept = kept.join(again, same, "left_anti").select("_row").unionByName(once)
    return unpacked(kept, docs.columns)
