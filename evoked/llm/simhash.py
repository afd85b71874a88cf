"""SimHash near-dedup by deletion-variant signatures.

A fingerprint of 64 bits is cut into so few segments that two fingerprints within the distance differ by at most one bit in
one of them. Each segment is indexed once for each of its bits, that bit made a wildcard, so that such two share a key.
Rows are shuffled by key; rows that meet are verified by the bits in which the fingerprints differ.

A meeting of many close fingerprints is not expanded into pairs: it is searched breadth first among those not yet
reached, and gives each a link to the one it was reached from, which connects exactly what all pairs would connect.
Components come from alternating large-star and small-star steps on those links, each step written to the shared folder;
the links of one hub are dealt over ``SALTS`` keys.

What is linked are fingerprints, not documents: those that are equal are one before anything is emitted, so groups of
copies cost one row each, and documents without an id link what they link. A component is named after its smallest doc_id.

Cases: null and empty texts have fingerprint zero and are linked like any other; fewer words than a shingle: the whole
sequence is one shingle; texts of any length are read whole, ``CHUNK`` shingles at a time; rows that are repeated or share
doc_id keep a row each, and a doc_id with several texts joins no components by that; a null doc_id links like any other and
gets the smallest doc_id it reaches, null if there is none; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoked.llm.common import checkpoint, hinted, settled, table

SEED = 42
#: Rows that meet are compared in blocks of so many at a time.
BLOCK = 65_536
#: Keys that the links of one node are dealt over, where there are more links than can be broadcast, some 10 MB.
SALTS, FEW_LINKS = 16, 100_000
#: At most so many rows are broadcast: some 50 MB.
BROADCAST_ROWS = 500_000
#: Shingles of a text whose bits are counted at a time.
CHUNK = 65_536


def spans(text: str | None, shingle: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The lower-cased words joined by spaces, and where its shingles are."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return b"", []
    size, k = len(tokens), min(shingle, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, size) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return b" ".join(tokens), list(zip(starts[: size - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))


def majority(hashes) -> int:
    """The bits set in over half of all hashes, which come in arrays of unsigned longs."""
    counts, n = np.zeros(64, np.int64), 0
    for h in hashes:
        counts += np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little") if n else 0


def fingerprint(text: str | None, shingle: int) -> int:
    """Over the XXH64 hashes (seed 42) of lower-cased shingles, repeats included."""
    joined, at = spans(text, shingle)
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in at[i : i + CHUNK]], dtype=np.uint64) for i in range(0, len(at), CHUNK))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, f): the fingerprint as a signed long."""

    def make(batches):
        for b in batches:
            f = np.array([fingerprint(t, shingle) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "f": f})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(make, "doc_id long, f long")


def cuts(bits: int, segments: int) -> list[tuple[int, int]]:
    """The segments as (first bit, width), as even as can be."""
    edges = [bits * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def variant_keys(prints: DataFrame, segments: int) -> DataFrame:
    """(key, node, f): a row for each segment and wildcard bit of each fingerprint."""
    keys, place = [], 0
    for first, width in cuts(64, segments):
        for bit in range(width):
            mask = ((1 << width) - 1) & ~(1 << bit)
            keys.append(f"xxhash64({place}, shiftrightunsigned(f, {first}) & {mask}L)")
            place += 1
    return prints.select("node", "f", F.expr(f"explode(array({', '.join(keys)}))").alias("key"))


def _forest(f: np.ndarray, nodes: np.ndarray, distance: int) -> tuple[list, list]:
    """Links that connect each part of what met; both ends of a link are within the distance."""
    left, a, b = np.arange(len(nodes)), [], []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at, near = frontier.pop(), []
            for i in range(0, len(left), BLOCK):
                near.append(np.bitwise_count(f[left[i : i + BLOCK]] ^ f[at]) <= distance)
            near = np.concatenate(near)
            if near.any():
                reached = left[near]
                a.extend(nodes[reached].tolist())
                b.extend([nodes[at]] * len(reached))
                frontier.extend(reached.tolist())
                left = left[~near]
    return a, b


def links(prints: DataFrame, distance: int, segments: int | None = None) -> DataFrame:
    """(a, b), b < a: pairs of ``prints`` (node, f) within ``distance`` that connect all such pairs. With ``segments`` unset
    there are as many as the guarantee takes: distance // 2 + 1."""

    def small_groups(key, node, f):
        """Groups as runs of equal keys, compared at growing lags; large groups are searched breadth first."""
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(edge)
        a, b = [], []
        for s, n in zip(edge[:-1][size > 16].tolist(), size[size > 16].tolist(), strict=True):
            x, y = map(lambda v: np.array(v, np.int64), _forest(f[s : s + n], node[s : s + n], distance))
            a.append(np.maximum(x, y))
            b.append(np.minimum(x, y))
        fit = np.repeat(size <= 16, size)
        key, node, f = key[fit], node[fit], f[fit]
        for lag in range(1, min(16, len(key))):
            same = np.flatnonzero(key[lag:] == key[:-lag])
            if not len(same):
                break
            near = same[np.bitwise_count(f[same] ^ f[same + lag]) <= distance]
            a.append(np.maximum(node[near], node[near + lag]))
            b.append(np.minimum(node[near], node[near + lag]))
        return pd.DataFrame({"a": np.concatenate([np.empty(0, np.int64), *a]), "b": np.concatenate([np.empty(0, np.int64), *b])}).drop_duplicates()

    def meet(batches):
        held = None
        for batch in batches:
            part = (batch["key"].to_numpy(), batch["node"].to_numpy(), batch["f"].to_numpy().view(np.uint64))
            held = part if held is None else tuple(np.concatenate(x) for x in zip(held, part, strict=True))
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                found = small_groups(*(x[:cut] for x in held))
                held = tuple(x[cut:].copy() for x in held)
                yield found
        if held is not None and len(held[0]):
            yield small_groups(*held)

    rows = variant_keys(prints, segments or distance // 2 + 1).select("key", "node", "f").repartition("key").sortWithinPartitions("key")
    return rows.mapInPandas(meet, "a long, b long").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) is connected with. Alternating star steps:
    every node's larger neighbours, then its smaller ones, are linked with its smallest one, until nothing changes."""
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    digest = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        if before[0] <= FEW_LINKS:
            return rows.join(F.broadcast(least), "a")
        dealt = least.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        return rows.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS))).join(dealt, ["a", "_salt"]).drop("_salt")

    before = digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = with_least(large, least).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = settled(joined.where("a <> b").distinct())
        after = digest(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, f, component_id), a row for each row of ``docs``."""
    prints = checkpoint(fingerprints(docs, shingle))
    unlike = checkpoint(prints.groupBy("f").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = components(links(unlike.select(F.col("f").alias("node"), "f"), distance)).select(F.col("node").alias("f"), "root")
    members = checkpoint(found.unionByName(found.select(F.col("root").alias("f"), "root").distinct()))
    # Most fingerprints are one document's and near no other; only the rest needs a name.
    rooted = unlike.join(hinted(members, BROADCAST_ROWS), "f", "left").where("n > 1 OR root IS NOT NULL")
    rooted = checkpoint(rooted.select("f", "least", F.coalesce("root", "f").alias("root")))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = checkpoint(rooted.select("f", "root").join(names, "root").select("f", "component_id", F.lit(True).alias("_named")))
    out = prints.join(hinted(named, BROADCAST_ROWS), "f", "left")
    return out.select("doc_id", "f", F.when(F.col("_named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
