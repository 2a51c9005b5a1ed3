"""Language-model scores from a log-frequency Bloom filter.

Word unigrams and bigrams of the training documents are counted; a count c is quantised to the level
1 + floor(log_base(c)), and the filter holds (n-gram, 1) ... (n-gram, level). Workers find a count by probing one
level after the other until one is missing, and smooth bigram with unigram probabilities.

The filter is made of segments, one for each range of n-gram hashes, each sized to its own entries. Segments are built where
the counts are summed. Up to ``filter_bytes`` the whole filter is broadcast; beyond it the n-grams that a chunk of documents asks
for travel to the segments instead, with the same answers. N-grams, words and counts move as compressed arrays, a row for each
chunk or task and hash range, so an n-gram that fills a third of all text is one number for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import text as X
from .tables import stored

END = np.uint64(0x5851F42D4C957F2D)     # the hash that stands for the end token, also the history of a first word
LEVEL_BASE = 1.5
BITS_PER_ENTRY = 10
PROBES = 7
CHUNK = 2 << 20                         # bytes of text in a chunk
FLUSH = 1 << 21                         # n-grams that a task gathers before it hands them on
SLICES = 16                             # hash ranges' groups in which it does, so that little is sorted at once
PROBE = 1 << 16                         # n-grams probed at once


def pack(a: np.ndarray) -> bytes:
    """An array as byte planes, compressed."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(b: bytes, kind) -> np.ndarray:
    size = int.from_bytes(b[:8], "little")
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(b[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(kind)


def pack_sorted(h: np.ndarray) -> bytes:
    """Ascending hashes by their differences."""
    return pack(np.diff(h, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def bucket_edges(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of each hash range within ascending hashes."""
    own = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(own, np.arange(buckets + 1, dtype=np.uint64))


def level_of(count: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(count) / np.log(base) + 1e-9).astype(np.int64)


def count_at(level: np.ndarray, base: float) -> np.ndarray:
    """The count a level stands for: the middle of its range; 0 at level 0."""
    return np.where(level > 0, np.maximum((base ** (level - 1) + base ** level - 1) / 2, 1.0), 0.0)


def _entry(h: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    g = X.mix(h + np.uint64(0x632BE59BD9B4E019) * np.asarray(level).astype(np.uint64))
    return g >> np.uint64(32), (g & np.uint64(0xFFFFFFFF)) | np.uint64(1)


def build_segment(h: np.ndarray, count: np.ndarray, base: float = LEVEL_BASE, bits_per_entry: int = BITS_PER_ENTRY) -> np.ndarray:
    """The bitmap (bytes) of one hash range: every n-gram at every level up to its own."""
    level = level_of(count, base)
    bits = max(64, -(-int(level.sum()) * bits_per_entry // 64) * 64)
    out = np.zeros(bits // 8, np.uint8)
    for k in range(1, int(level.max(initial=0)) + 1):
        a, b = _entry(h[level >= k], k)
        for i in range(PROBES):
            at = (a + np.uint64(i) * b) % np.uint64(bits)
            np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))
    return out


class Filter:
    """Segments side by side; ``levels`` probes for ascending hashes of any range."""

    def __init__(self, segments: list[np.ndarray], buckets: int, first: int = 0):
        self.buckets, self.first = buckets, first
        self.bits = np.array([8 * len(s) for s in segments], np.uint64)
        self.start = np.concatenate([[0], np.cumsum([len(s) for s in segments])])[:-1].astype(np.uint64)
        self.data = np.concatenate(segments) if segments else np.zeros(0, np.uint8)

    def levels(self, h: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[self._levels(h[k:k + PROBE]) for k in range(0, len(h), PROBE)]])

    def _levels(self, h: np.ndarray) -> np.ndarray:
        own = (((h >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)).astype(np.int64) - self.first
        bits, start = self.bits[own], self.start[own]
        out, alive, k = np.zeros(len(h), np.int64), np.arange(len(h)), 0
        while len(alive):
            k += 1
            a, b = _entry(h[alive], k)
            for i in range(PROBES):
                at = (a + np.uint64(i) * b) % bits[alive]
                hit = (self.data[(start[alive] + (at >> np.uint64(3))).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                alive, a, b = alive[hit], a[hit], b[hit]
            out[alive] = k
        return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words of ``data``, lower-cased, some at a time: memory follows ``CHUNK_BYTES`` or the longest word."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, first + X.CHUNK_BYTES, "right")))
        out[i:j] = X.span_hashes(X.BYTE_CODE[X.LOWER[data[first:ends[j - 1]]]], starts[i:j] - first, ends[i:j] - first)
        i = j
    return out


def chunked(docs: DataFrame, held_out: Column) -> DataFrame:
    """Documents as chunks of tokens: one row per chunk of about 2 MB of text, or per stretch of a longer document.

    Columns: chunk, and by document rid, doc_id, held and tokens (how many), then the distinct word hashes (ascending), the
    tokens as places among them and the hash before the chunk's first token.
    """
    src = docs.select(F.col("doc_id"), held_out.alias("held"), F.col("text").cast("string"))
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("rids", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(src.schema["doc_id"].dataType)),
                           T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.BinaryType()), T.StructField("vocab", T.BinaryType()),
                           T.StructField("tokens", T.BinaryType()), T.StructField("before", T.LongType())])

    def run(batches):
        chunk = rid = TaskContext.get().partitionId() << 36

        def row(rids, ids, held, sizes, hashes, before):
            nonlocal chunk
            vocab, which = np.unique(hashes, return_inverse=True)
            chunk += 1
            kind = np.uint16 if len(vocab) <= 1 << 16 else np.uint32
            return pa.RecordBatch.from_arrays([pa.array([chunk - 1]), pa.array([rids], pa.list_(pa.int64())), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([held]),
                                               pa.array([pack(sizes.astype(np.uint32))]), pa.array([pack_sorted(vocab)]), pa.array([pack(which.astype(kind))]),
                                               pa.array([int(before.astype(np.int64))])], names=schema.names)
        for b in batches:
            data, offs = X.utf8(b.column(2))
            held = b.column(1).to_pylist()
            for i, j, d, o in X.chunks(data, offs, CHUNK):
                rids, ids = list(range(rid, rid + j - i)), b.column(0).slice(i, j - i)
                rid += j - i
                before, s0 = END, 0
                while True:                             # one turn, but for a document longer than a chunk
                    s1 = len(d)
                    if j - i == 1 and s1 - s0 > 2 * CHUNK:
                        s1 = s0 + CHUNK
                        while s1 < len(d) and not X.SPACE[d[s1]]:
                            s1 += 1
                    last = s1 == len(d)
                    part = d[s0:s1]
                    po = o if j - i > 1 else np.array([0, len(part)])
                    starts, ends, doc = X.words(part, po)
                    h = word_hashes(part, starts, ends)
                    sizes = np.bincount(doc, minlength=j - i) + (1 if last else 0)
                    if last:
                        at = np.cumsum(sizes) - 1
                        full = np.full(len(h) + j - i, END)
                        body = np.ones(len(full), bool)
                        body[at] = False
                        full[body] = h
                        h = full
                    if len(h):
                        yield row(rids, ids, held[i:j], sizes, h, before)
                        before = h[-1]
                    s0 = s1
                    if last:
                        break

    return src.mapInArrow(run, schema)


class Chunk:
    """One row of ``chunked``, unpacked."""

    def __init__(self, held, sizes, vocab, tokens, before):
        self.vocab = unpack_sorted(vocab)
        self.tokens = unpack(tokens, np.uint16 if len(self.vocab) <= 1 << 16 else np.uint32).astype(np.int64)
        self.sizes = unpack(sizes, np.uint32).astype(np.int64)
        self.train = np.repeat(~np.array(held, bool), self.sizes)
        own = self.vocab[self.tokens]
        history = np.empty_like(own)
        history[0] = np.uint64(before & X._MASK)
        history[1:] = own[:-1]
        self.history = history
        self.bigrams = X.pair(history, own)
        self.unigrams = X.mix(self.vocab + np.uint64(1))     # as entries of the filter, apart from the bigrams


def _chunk_of(row: dict) -> Chunk:
    return Chunk(row["held"], row["sizes"], row["vocab"], row["tokens"], row["before"])


def word_requests(chunks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, words, counts): a chunk's distinct words of one hash range and their training counts in it."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                c = _chunk_of(r)
                count = np.bincount(c.tokens[c.train], minlength=len(c.vocab)).astype(np.uint32)
                e = bucket_edges(c.vocab, buckets)
                at = np.flatnonzero(e[1:] > e[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), r["chunk"])),
                                                  pa.array([pack_sorted(c.vocab[e[k]:e[k + 1]]) for k in at], pa.binary()),
                                                  pa.array([pack(count[e[k]:e[k + 1]]) for k in at], pa.binary())], names=["bucket", "chunk", "words", "counts"])

    return chunks.select("chunk", "held", "sizes", "vocab", "tokens", "before").mapInArrow(run, "bucket int, chunk long, words binary, counts binary")


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and the sums of their counts."""
    every = np.concatenate([h for h, _ in parts])
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])[:len(every)])
    n = np.concatenate([n for _, n in parts])[order]
    return every[first], np.add.reduceat(n, first, dtype=np.uint64) if len(first) else n


class Totals:
    """Counts by hash, summed as they come: no more entries wait than there are distinct hashes (or ``FLUSH`` / 8), so memory follows these."""

    def __init__(self):
        self.h, self.n, self.waiting, self.size = np.zeros(0, np.uint64), np.zeros(0, np.uint64), [], 0

    def add(self, h: np.ndarray, n: np.ndarray) -> None:
        self.waiting.append((h, n.astype(np.uint64)))
        self.size += len(h)
        if self.size > max(FLUSH >> 3, len(self.h)):
            self.settle()

    def settle(self) -> None:
        """Sum what waits into ``h`` (ascending) and ``n``."""
        self.h, self.n = summed([(self.h, self.n), *self.waiting])
        self.waiting, self.size = [], 0


def word_counts(requests: DataFrame) -> DataFrame:
    """(bucket, chunk, counts, n, v): for every request the training counts over all documents, and once for each hash
    range (chunk -1) its training tokens and distinct words. The requests of a range are summed as they stream in and wait compressed."""
    names = ["bucket", "chunk", "counts", "n", "v"]

    def reply(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(chunks, counts, n, v):
            k = len(chunks)
            return pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * k, pa.int32()), pa.array(chunks, pa.int64()), pa.array(counts, pa.binary()),
                                               pa.array([n] * k, pa.int64()), pa.array([v] * k, pa.int64())], names=names)
        total, asked = Totals(), []
        for b in batches:
            for r in b.select(["chunk", "words", "counts"]).to_pylist():
                total.add(unpack_sorted(r["words"]), unpack(r["counts"], np.uint32))
                asked.append((r["chunk"], r["words"]))
        total.settle()
        yield out([-1], [None], int(total.n.sum()), int((total.n > 0).sum()))
        for at in range(0, len(asked), 64):
            some = asked[at:at + 64]
            yield out([c for c, _ in some], [pack(total.n[np.searchsorted(total.h, unpack_sorted(w))]) for _, w in some], 0, 0)

    return requests.groupBy("bucket").applyInArrow(reply, "bucket int, chunk long, counts binary, n long, v long")


def ngram_counts(chunks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, grams, counts): training n-grams summed within a task, by hash range."""
    def run(batches):
        held, size = [], 0

        def flush():
            edges, step = [bucket_edges(h, buckets) for h, _ in held], -(-buckets // SLICES)
            for low in range(0, buckets, step):
                high = min(low + step, buckets)
                h, c = summed([(h[e[low]:e[high]], n[e[low]:e[high]]) for (h, n), e in zip(held, edges)])
                e, c = bucket_edges(h, buckets), c.astype(np.uint32)
                at = np.flatnonzero(e[1:] > e[:-1])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([pack_sorted(h[e[k]:e[k + 1]]) for k in at], pa.binary()),
                                                      pa.array([pack(c[e[k]:e[k + 1]]) for k in at], pa.binary())], names=["bucket", "grams", "counts"])
        for b in batches:
            for r in b.to_pylist():
                c = _chunk_of(r)
                for h in (c.bigrams[c.train], c.unigrams[c.tokens[c.train]]):
                    u, n = np.unique(h, return_counts=True)
                    held.append((u, n.astype(np.uint32)))
                    size += len(u)
                if size > FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return chunks.select("chunk", "held", "sizes", "vocab", "tokens", "before").mapInArrow(run, "bucket int, grams binary, counts binary")


def filter_segments(grams: DataFrame, base: float, bits_per_entry: int) -> DataFrame:
    """(bucket, segment): the filter's bitmap of each hash range."""
    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Totals()
        for b in batches:
            for r in b.select(["grams", "counts"]).to_pylist():
                total.add(unpack_sorted(r["grams"]), unpack(r["counts"], np.uint32))
        total.settle()
        bits = build_segment(total.h, total.n, base, bits_per_entry).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bits], pa.binary())], names=["bucket", "segment"])

    return grams.groupBy("bucket").applyInArrow(build, "bucket int, segment binary")


def probed_by_shuffle(chunks: DataFrame, segments: DataFrame, buckets: int) -> DataFrame:
    """(chunk, levels): what ``Filter.levels`` says for a chunk's ascending distinct n-grams, asked at the segments."""
    def ask(batches):
        for b in batches:
            for r in b.to_pylist():
                h = asked_by(_chunk_of(r))[0]
                e = bucket_edges(h, buckets)
                at = np.flatnonzero(e[1:] > e[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), r["chunk"])), pa.array([pack_sorted(h[e[k]:e[k + 1]]) for k in at], pa.binary())],
                                                 names=["bucket", "chunk", "grams"])

    def answer(asked: pa.Table, segment: pa.Table) -> pa.Table:
        own = asked["bucket"][0].as_py() if asked.num_rows else 0
        f = Filter([np.frombuffer(x, np.uint8) for x in segment["segment"].to_pylist()] or [np.zeros(8, np.uint8)], buckets, own)
        return pa.table({"bucket": asked["bucket"], "chunk": asked["chunk"], "levels": pa.array([pack(f.levels(unpack_sorted(x)).astype(np.uint8)) for x in asked["grams"].to_pylist()], pa.binary())})

    asked = chunks.select("chunk", "held", "sizes", "vocab", "tokens", "before").mapInArrow(ask, "bucket int, chunk long, grams binary")
    got = asked.groupBy("bucket").cogroup(segments.groupBy("bucket")).applyInArrow(answer, "bucket int, chunk long, levels binary")
    return got.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "levels"))).alias("levels"))


def asked_by(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ascending n-grams, place of each word's own unigram, place of each token's bigram, place of each token's history)."""
    past, back = np.unique(c.history, return_inverse=True)
    u = X.mix(past + np.uint64(1))
    h, which = np.unique(np.concatenate([c.unigrams, c.bigrams, u]), return_inverse=True)
    v, n = len(c.vocab), len(c.tokens)
    return h, which[:v], which[v:v + n], which[v + n:][back]


def score_documents(docs: DataFrame, held_out: Column, mu: float = 50.0, base: float = LEVEL_BASE, bits_per_entry: int = BITS_PER_ENTRY,
                    filter_bytes: int = 256 << 20) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows where ``held_out`` is false or null are learned from. base_score uses exact add-one unigram counts; score uses the filter:
    P(w|h) = (c(hw) + mu P(w)) / (c(h) + mu), P(w) = (c(w) + 1) / (N + V + 1), the first word after an end token. Null and empty texts are one
    end token; repeated rows are scored alike; without training rows all counts are 0; an empty table gives an empty result.
    ``filter_bytes`` bounds what is broadcast.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = stored(chunked(docs, F.coalesce(held_out, F.lit(False))), "lm-chunks")
    counts = stored(word_counts(word_requests(chunks, buckets)), "lm-words")
    total = counts.where("chunk = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    segments = stored(filter_segments(ngram_counts(chunks, buckets), base, bits_per_entry), "lm-filter")
    size = segments.agg(F.coalesce(F.sum(F.octet_length("segment")), F.lit(0))).first()[0]
    replies = counts.where("chunk >= 0").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias("replies"))
    rows = chunks.join(replies, "chunk")
    sent = None
    if size <= filter_bytes:                            # the checked bound of the broadcast
        have = {r["bucket"]: np.frombuffer(r["segment"], np.uint8) for r in segments.toLocalIterator()}
        sent = spark.sparkContext.broadcast(Filter([have.get(k, np.zeros(8, np.uint8)) for k in range(buckets)], buckets))
        rows = rows.withColumn("levels", F.lit(None).cast("array<struct<bucket:int,levels:binary>>"))
    else:
        rows = rows.join(probed_by_shuffle(chunks, segments, buckets), "chunk")
    n_all, v_all = int(total["n"]), int(total["v"])
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("doc_id", chunks.schema["ids"].dataType.elementType), T.StructField("held_out", T.BooleanType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("lm", T.DoubleType())])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                c = _chunk_of(r)
                exact = np.concatenate([unpack(x["counts"], np.uint64) for x in r["replies"]])[c.tokens]
                h, uni, bi, past = asked_by(c)
                level = sent.value.levels(h) if sent is not None else np.concatenate([unpack(x["levels"], np.uint8) for x in r["levels"]]).astype(np.int64)
                near = count_at(level, base)
                p1 = (near[uni] + 1)[c.tokens] / (n_all + v_all + 1)
                before = near[past]
                p = (np.minimum(near[bi], before) + mu * p1) / (before + mu)
                bound = np.concatenate([[0], np.cumsum(c.sizes)])
                yield pa.RecordBatch.from_arrays([pa.array(r["rids"], pa.int64()), pa.array(r["ids"], b.column(2).type.value_type), pa.array(r["held"]), pa.array(c.sizes),
                                                  pa.array(X.sums((exact > 0).astype(np.int64), bound)), pa.array(X.sums(np.log10((exact + np.uint64(1)).astype(float)), bound)),
                                                  pa.array(X.sums(np.log10(p), bound))], names=schema.names)

    parts = rows.select("chunk", "rids", "ids", "held", "sizes", "vocab", "tokens", "before", "replies", "levels").mapInArrow(run, schema)
    return (parts.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
                                     F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("lm").alias("score"))
            .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"),
                    (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(n_all + v_all + 1)))).alias("base_score"), "score"))
