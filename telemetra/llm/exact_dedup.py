"""Exact deduplication by composable polynomial fingerprints.

A text is normalised by deleting every byte of ``[\\x20\\x09-\\x0D]``. Its fingerprint is its normalised length and
two polynomials modulo primes below 2**31. A piece of a text has such a fingerprint too, and those of adjoining
pieces combine by shifting the second by the length of the first, so pieces of one huge document are hashed
independently. Texts with equal fingerprints are then compared chunk by chunk; should two different texts share one,
their group is divided by the texts themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from . import text as X
from .tables import fixed_bitmap, stored

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525)
PART = 1 << 16                          # bytes of a chunk in the comparison
KEY = ["n_bytes", "f1", "f2"]
_tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, prime: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo prime for k up to one run of bytes."""
    if (base, prime) not in _tables:
        both = []
        for b in (base % prime, pow(base, -1, prime)):
            out = np.ones(X.CHUNK_BYTES + 1, np.uint64)
            have = 1
            while have < len(out):       # doubling: the known powers, shifted by base**have
                step = min(have, len(out) - have)
                out[have:have + step] = out[:step] * np.uint64(pow(b, have, prime)) % np.uint64(prime)
                have += step
            both.append(out)
        _tables[base, prime] = (both[0], both[1])
    return _tables[base, prime]


def piece_hashes(norm: np.ndarray, offs: np.ndarray, base: int, prime: int) -> np.ndarray:
    """Fingerprint of every piece [offs[i], offs[i+1]) of at most one run of bytes: the sum of
    (byte + 1) * base**position, modulo prime."""
    power, inverse = _power_tables(base, prime)
    total = X.sums((norm.astype(np.uint64) + np.uint64(1)) * power[:len(norm)], offs)   # below 2**60: no overflow
    return total % np.uint64(prime) * inverse[offs[:-1]] % np.uint64(prime)


def combine(a: tuple[int, int], b: tuple[int, int], base: int, prime: int) -> tuple[int, int]:
    """(hash, length) of two adjoining pieces: the second shifted by the length of the first. Associative,
    with (0, 0) as neutral element."""
    return (a[0] + pow(base, a[1], prime) * b[0]) % prime, a[1] + b[1]


def fingerprints(norm: np.ndarray, offs: np.ndarray, bases=BASES, primes=PRIMES) -> list[np.ndarray]:
    """The two polynomial fingerprints of each document of ``norm``."""
    out = [np.zeros(len(offs) - 1, np.int64) for _ in primes]
    for i, j, d, o in X.chunks(norm, offs):
        for k, (base, prime) in enumerate(zip(bases, primes)):
            if len(d) <= X.CHUNK_BYTES:
                out[k][i:j] = piece_hashes(d, o, base, prime)
            else:                        # one long document: hash its pieces, then combine them
                state = (0, 0)
                for at in range(0, len(d), X.CHUNK_BYTES):
                    p = d[at:at + X.CHUNK_BYTES]
                    state = combine(state, (int(piece_hashes(p, np.array([0, len(p)]), base, prime)[0]), len(p)), base, prime)
                out[k][i] = state[0]
    return out


def normalised(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normalised bytes, offsets by document, code points of each original text)."""
    data, offs = X.utf8(col)
    keep = ~X.SPACE[data]
    at = np.concatenate([[0], np.cumsum(X.sums(keep, offs, np.int64))])
    points = X.sums((data & 0xC0) != 0x80, offs, np.int64)
    return data[keep], at, points


def digests(docs: DataFrame, primes=PRIMES) -> DataFrame:
    """One row per row of ``docs``: rid (unique), doc_id, text_hash (of the original text), n_points, n_bytes, f1,
    f2 and text_sha256. Null text counts as empty."""
    src = docs.select(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"), F.col("text").cast("string"))
    schema = T.StructType([T.StructField("rid", T.LongType()), src.schema["doc_id"], T.StructField("text_hash", T.LongType()),
                           *[T.StructField(c, T.LongType()) for c in ["n_points", *KEY]], T.StructField("text_sha256", T.StringType())])

    def run(batches):
        rid = TaskContext.get().partitionId() << 40
        for b in batches:
            norm, offs, points = normalised(b.column(2))
            f1, f2 = fingerprints(norm, offs, primes=primes)
            sha = [hashlib.sha256(norm[s:e]).hexdigest() for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + n)), b.column(0), b.column(1), pa.array(points),
                                              pa.array(np.diff(offs)), pa.array(f1), pa.array(f2), pa.array(sha, pa.string())], names=schema.names)
            rid += n

    return src.mapInArrow(run, schema)


def parts(docs: DataFrame, primes, wanted=None, size: int = PART) -> DataFrame:
    """Normalised texts in chunks: (n_bytes, f1, f2, doc_id, text_hash, part_no, part), of the texts whose fingerprint is in the
    bitmap ``wanted`` (which lets some others through). ``size`` None: the whole text in one chunk."""
    src = docs.select(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"), F.col("text").cast("string"))
    schema = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()),
                           src.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("part_no", T.LongType()), T.StructField("part", T.BinaryType())])

    def run(batches):
        bits = wanted.value if wanted is not None else None
        for b in batches:
            norm, offs, _ = normalised(b.column(2))
            f1, f2 = fingerprints(norm, offs, primes=primes)
            at = np.arange(b.num_rows) if bits is None else np.flatnonzero(bits.has(f1 * (1 << 31) + f2))
            row, no, out = [], [], []
            for r in at.tolist():
                s, e = int(offs[r]), int(offs[r + 1])
                step = size or max(1, e - s)
                for k, p in enumerate(range(s, max(e, s + 1), step)):
                    row.append(r)
                    no.append(k)
                    out.append(norm[p:min(p + step, e)].tobytes())
            at = np.array(row, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(offs)[at]), pa.array(f1[at]), pa.array(f2[at]), b.column(0).take(pa.array(at)),
                                              b.column(1).take(pa.array(at)), pa.array(no, pa.int64()), pa.array(out, pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema)


def _classes(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their class's keep_id, group_size and kept: the row with the most code points, then the smallest
    doc_id (null last), then the smallest rid. Classes are stored before the join: both its sides are then plain shuffles, which
    Spark splits where one class holds many rows."""
    order = F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col("rid").alias("r"))
    best = stored(rows.groupBy(*by).agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size")), "classes")
    return (rows.join(best, by).select("doc_id", F.col("best.d").alias("keep_id"), "group_size",
                                       (F.col("rid") == F.col("best.r")).alias("kept"), "text_sha256", "text_hash"))


def exact_duplicates(docs: DataFrame, primes=PRIMES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, text_hash.

    Texts are equal when they are identical after deleting white space; null and blank texts are all equal to
    the empty one. Exactly one row of a class is kept, also among repeated rows with one doc_id. An empty table gives an
    empty result; other columns are not read. ``primes`` is for tests, which force collisions with small ones.
    """
    spark = docs.sparkSession
    rows = stored(digests(docs, primes), "digests")
    shared = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wanted = spark.sparkContext.broadcast(fixed_bitmap(shared.select((F.col("f1") * (1 << 31) + F.col("f2")).alias("h"))))
    chunks = parts(docs, primes, wanted).groupBy(*KEY, "part_no").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    differ = stored(chunks.where("lo <> hi").select(*KEY).distinct(), "collisions")
    if differ.isEmpty():
        return _classes(rows, KEY)
    texts = (parts(docs, primes, wanted, None).join(differ, KEY, "left_semi").groupBy(*KEY, "doc_id", "text_hash").agg(F.min("part").alias("whole")))
    null_safe = [rows[c].eqNullSafe(texts[c]) for c in ["doc_id", "text_hash", *KEY]]
    apart = rows.join(differ, KEY, "left_semi").join(texts, null_safe).select(*[rows[c] for c in rows.columns], "whole")
    return _classes(rows.join(differ, KEY, "left_anti"), KEY).unionByName(_classes(apart, [*KEY, "whole"]))
