"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A 64-bit fingerprint is eight bytes at eight positions. Two fingerprints that differ in at most d bits differ in at
most d bytes, so they share at least 8 - d positional bytes. Posting lists of single bytes would hold a 256th of all
fingerprints each; lists are therefore keyed by the bytes at three positions, for a family of position triples of which
every set of four positions contains one. Pairs met in a list are tallied by their shared positional bytes, those that
reach the guaranteed minimum are verified by their bit distance, and linked pairs are joined to components.

Equal fingerprints are one posting. A long list is cut into blocks that are compared two by two in different
tasks, and each run of comparisons reports a spanning forest of its links, not every pair.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import text as X
from .tables import stored

BLOCK = 1024           # postings of a list that one task compares with as many others at once
SEGMENT = 50_000       # shingles of one long text hashed at once


def position_triples() -> list[tuple[int, int, int]]:
    """Twenty triples of the eight positions such that any four positions contain one: with the positions dealt to
    three rings, a triple inside a ring, or two positions of a ring and one of the next."""
    ring = [0, 0, 0, 1, 1, 1, 2, 2]
    found = []
    for t in combinations(range(8), 3):
        count = [sum(ring[p] == r for p in t) for r in range(3)]
        if max(count) == 3 or any(count[r] == 2 and count[(r + 1) % 3] == 1 for r in range(3)):
            found.append(t)
    return found


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of one lower-cased text: XXH64 (seed 42) of each run of ``shingle`` words, repeats included. A text
    with fewer words is one shingle, one without words has fingerprint 0."""
    xx, count, total, tail = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    at, n = 0, len(text)
    while at < n:                                   # long texts by stretches that end after a word
        end = n
        if n - at > SEGMENT * 20:
            end = at + SEGMENT * 20
            while end < n and not X.SPACE[text[end]]:
                end += 1
        w = tail + text[at:end].split()
        at = end
        if len(w) >= shingle:
            joined = b" ".join(w)
            size = np.fromiter(map(len, w), np.int64, len(w))
            stop = np.cumsum(size + 1) - 1
            start = stop - size
            h = [xx(joined[a:b], 42) for a, b in zip(start[:len(w) - shingle + 1].tolist(), stop[shingle - 1:].tolist())]
            count += _bits(np.array(h, np.uint64))
            total += len(h)
            tail = w[len(w) - shingle + 1:] if shingle > 1 else []
        else:
            tail = w
    if total == 0:
        if not tail:
            return 0
        count, total = _bits(np.array([xx(b" ".join(tail), 42)], np.uint64)), 1
    return int(np.packbits(2 * count > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp) of each row: the SimHash as a signed 64-bit number. Null text counts as empty."""
    src = docs.select(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"), F.col("text").cast("string"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            data, offs = X.utf8(b.column(2))
            low = X.LOWER[data].tobytes()
            fp = [fingerprint(low[s:e], shingle) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fp, np.uint64).view(np.int64))], names=schema.names)

    return src.mapInArrow(run, schema)


def _keys(fp: str = "fp") -> Column:
    """The twenty list keys of a fingerprint: number of the triple, then its three bytes."""
    byte = [F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    return F.array(*[F.lit(k << 24).cast("long") + byte[a] * 65536 + byte[b] * 256 + byte[c] for k, (a, b, c) in enumerate(position_triples())])


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of nodes 0..n-1 linked pairwise, the smallest node of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def linked(fp: np.ndarray, group: np.ndarray, block: np.ndarray, one: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the fingerprints of each group (rows are sorted by group). Within a group of two blocks only
    pairs across the blocks are compared, the others have a group of their own."""
    n = len(fp)
    end = np.searchsorted(group, group, "right")
    left = end - np.arange(n) - 1                   # partners after a row
    found_a, found_b, at, d = [], [], np.arange(n), 1
    while True:
        at = at[left[at] >= d]
        if not len(at):
            break
        x = fp[at] ^ fp[at + d]
        same = 8 - np.count_nonzero(x.view(np.uint8).reshape(-1, 8), axis=1)           # the tally of shared positional bytes
        ok = (same >= 8 - distance) & (one[at] | (block[at] != block[at + d]))
        ok[ok] = np.bitwise_count(x[ok]) <= distance                                   # and the verification
        found_a.append(at[ok])
        found_b.append(at[ok] + d)
        d += 1
    if not found_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    root = forest(np.concatenate(found_a), np.concatenate(found_b), n)
    child = np.flatnonzero(root != np.arange(n))
    return fp[child], fp[root[child]]


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) among the distinct fingerprints ``fps`` (fp) whose closure joins every two that differ in at most
    ``distance`` bits (0 to 4)."""
    if not 0 <= distance <= 4:
        raise ValueError("the position triples guarantee a shared list for 0 to 4 differing bits")
    posts = fps.select("fp", F.explode(_keys()).alias("key"))
    lists = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cut = posts.join(lists, "key").withColumn("m", F.ceil(F.col("n") / BLOCK)).withColumn(
        "block", F.pmod(F.xxhash64("fp", "key"), F.col("m")).cast("int"))
    met = cut.select("key", "fp", "block", F.explode(F.sequence(F.lit(0), (F.col("m") - 1).cast("int"))).alias("other"))
    dealt = met.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "fp", "block")
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches):
        held = None
        def compare(cols):
            key, lo, hi, fp, block = cols
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            a, b = linked(np.ascontiguousarray(fp).view(np.uint64), np.cumsum(new), block, lo == hi, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
        for x in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in x.columns]
            cols = cols if held is None else [np.concatenate([h, c]) for h, c in zip(held, cols)]
            differs = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1])) if len(cols[0]) else []
            done = int(differs[-1]) + 1 if len(differs) else 0       # the last group may go on in the next batch; it is at most two blocks
            if done:
                yield compare([c[:done] for c in cols])
            held = [c[done:] for c in cols]
        if held is not None and len(held[0]):
            yield compare(held)

    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the root is one node of its component.

    Alternating rounds link each node's larger, then its smaller neighbours to its smallest one, until every edge is a
    star's. A node's minimum is a partial aggregate joined back, so a hub is never one task's group; each round is stored.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            out = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            low = down.groupBy("a").agg(F.min("b").alias("m"))
            out = (down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                   .unionByName(low.select("a", F.col("m").alias("b"))))
        return out.where("a <> b").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = mark(edges)
    for _ in range(most):
        if seen[0] == 0:
            break
        edges = stored(star(star(edges, True), False), "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fp, component_id, text_hash, kept.

    component_id is the smallest doc_id reachable through links of at most ``distance`` differing bits; null only where all
    ids of the component are null. Null and blank texts have fingerprint 0, which links like any other. Repeated rows share a
    component. ``kept`` marks one row of each component: the smallest (doc_id, text hash), nulls last. An empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, shingle), "simhash")
    first = F.struct(F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    nodes = stored(rows.groupBy("fp").agg(F.min(first).alias("first")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), distance))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    chosen = rooted.groupBy("root").agg(F.min("first").alias("chosen"))
    by_fp = rooted.join(chosen, "root").select(F.col("fp").alias("__fp"), "chosen")
    same = F.col("doc_id").eqNullSafe(F.col("chosen.d")) & (F.col("text_hash") == F.col("chosen.h"))
    return rows.join(by_fp, F.col("fp") == F.col("__fp")).select("doc_id", "fp", F.col("chosen.d").alias("component_id"), "text_hash", same.alias("kept"))
