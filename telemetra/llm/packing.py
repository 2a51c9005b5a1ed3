"""Token packing by shortest-pack-first over the histogram of lengths.

Every document becomes token ids and an end id, cut into pieces of at most ``window`` ids. Only the histogram of piece
lengths (at most ``window`` rows) reaches the driver, which places lengths longest first into the shortest pack with
room and counts packing patterns, not packs. Each pattern slot owns a range of ranks of its length; pieces are ranked
within their length and joined to the slots by rank.
"""

from __future__ import annotations

import os
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import text as X

WINDOW = 1024
END_ID = 0
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


class ByteLevelEncoder:
    """Ids of whole runs of texts, as the tokenizer file gives them without special tokens.

    Texts are cut into pre-tokens with array operations; each distinct pre-token is encoded once by the
    ``tokenizers`` library and its ids are reused. The class of a code point is asked of the library's own pre-tokenizer when
    it is first met. Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str):
        import json
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec.get("normalizer") or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.kind = np.full(0x110000, 255, np.uint8)
        self.spans_seen = X.SpanIds()

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        kind = self.kind[points]
        if (kind == 255).any():
            pre = self.tok.pre_tokenizer.pre_tokenize_str
            for c in np.unique(points[kind == 255]).tolist():
                self.kind[c] = next((k for k, s in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if len(pre(s + chr(c))) == 1), _SPACE)
            kind = self.kind[points]
        return kind

    def spans(self, points: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Start of every pre-token: runs of letters, numbers, other signs or white space; one blank before a run belongs to
        it; the last white space before a run stands alone otherwise; an apostrophe takes a contraction's ending."""
        n = len(points)
        kind = self._kinds(points)
        first = np.zeros(n + 1, bool)
        first[offs] = True
        run = first[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        space = kind == _SPACE
        before = np.zeros(n, bool)                       # white space with a run of something else after it in its text
        before[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
        start |= before
        joins = np.zeros(n, bool)                        # runs whose blank comes with them
        joins[1:] = before[:-1] & (points[:-1] == 32)
        start &= ~joins
        quote = np.flatnonzero(start & (points == 39))
        if len(quote):
            doc_end = offs[np.searchsorted(offs, quote, "right")]
            two = np.concatenate([points, np.zeros(3, points.dtype)])
            a, b = two[quote + 1], two[quote + 2]
            one_left, two_left = quote + 1 < doc_end, quote + 2 < doc_end
            short = one_left & np.isin(a, [ord(c) for c in "stmd"])
            long = two_left & ~short & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
            take = quote[short | long]
            width = np.where(short, 2, 3)[short | long]
            start[take + 1] = False
            stop = take + width
            inside = stop < n
            start[stop[inside]] = True
        return np.flatnonzero(start)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by document) of a run of documents in UTF-8."""
        whole, points, doc = X.code_points(data, offs)
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        starts = self.spans(points, doc)

        def encode(s, e):
            texts = [whole[a:b] for a, b in zip(s.tolist(), e.tolist())]
            return [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        ids, total = self.spans_seen.encode(points, starts, np.append(starts[1:], len(points)), encode)
        return ids, total[np.searchsorted(starts, doc)]


_encoders: dict[str, ByteLevelEncoder] = {}


def encoder(path: str) -> ByteLevelEncoder:
    """The encoder of a tokenizer file and the spans it has met, kept by a worker process from task to task."""
    if path not in _encoders:
        _encoders[path] = ByteLevelEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text): doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, and source, nth: the n-th piece of its length in that source partition.

    A document's ids end with ``end_id``, so null and empty texts have one piece of one id. Each is cut after every
    ``window`` ids. Store the result before ranking it: source and nth hold for one evaluation.
    """
    src = docs.select(F.col("doc_id"), F.col("text").cast("string"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
                           T.StructField("source", T.IntegerType()), T.StructField("nth", T.LongType())])

    def run(batches):
        enc, source, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for b in batches:
            pa.default_memory_pool().release_unused()
            data, offs = X.utf8(b.column(1))
            held: list[np.ndarray] = []
            for i, j, d, o, begins, ends in X.stretches(data, offs):
                ids, at = enc.encode(d, o)
                if not (begins and ends):                # a long document: its ids, stretch by stretch
                    held.append(ids)
                    if not ends:
                        continue
                    ids, held = np.concatenate(held), []
                    at = np.array([0, len(ids)])
                n = j - i
                count = np.diff(at) + 1
                bound = np.concatenate([[0], np.cumsum(count)])
                flat = np.full(bound[-1], end_id, "<u4")
                body = np.ones(len(flat), bool)
                body[bound[1:] - 1] = False
                flat[body] = ids
                cuts = -(-count // window)
                row = np.repeat(np.arange(n), cuts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * window
                length = np.minimum(window, count[row] - start)
                begin = bound[row] + start
                order = np.argsort(length, kind="stable")
                nth = np.empty(len(row), np.int64)
                by = length[order]
                nth[order] = np.arange(len(row)) - np.searchsorted(by, by) + seen[by]
                seen += np.bincount(length, minlength=window + 1)
                cut = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((np.append(begin, bound[-1]) * 4).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n).take(pa.array(row)), pa.array(start), pa.array(length), cut,
                                                  pa.array(count[row]), pa.array(np.full(len(row), source, np.int32)), pa.array(nth)], names=schema.names)

    return src.mapInArrow(run, schema)


def patterns(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in order of placing, number of packs) of a histogram length -> count.

    Lengths are placed longest first, each into the shortest pack with room; packs alike are one entry, so the work follows
    the window, not the number of pieces.
    """
    packs: dict[int, list[list]] = defaultdict(list)              # room left -> [pattern, count]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, held in packs.items() if held and r >= length), default=None)
            if room is None:
                packs[window - length].append([(length,), left])
                break
            entry = packs[room][-1]
            used = min(left, entry[1])
            entry[1] -= used
            if not entry[1]:
                packs[room].pop()
            packs[room - length].append([entry[0] + (length,), used])
            left -= used
    return [(tuple(p), n) for r in sorted(packs) for p, n in packs[r] if n]


def slots(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, offset) of every pattern slot."""
    out, rank, sequence = [], defaultdict(int), 0
    for lengths, n in found:
        offset = 0
        for length in lengths:
            out.append((length, rank[length], rank[length] + n, sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    return out


def place(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """``cut`` (stored pieces, with or without their ids) with sequence_id and offset instead of source and nth.

    Ranks need no sort: a piece's rank is its number within its source plus the counts of earlier sources, so a length
    that holds a third of all pieces stays spread. The slot table has a few rows for each of ``window`` lengths and is broadcast.
    """
    spark = cut.sparkSession
    counts = cut.groupBy("source", "length").agg(F.max("nth").alias("last"))
    before = F.coalesce(F.sum(F.col("last") + 1).over(Window.partitionBy("length").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("source", "length", before.alias("base"))
    found = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.createDataFrame(slots(patterns(found, window)), "length long, lo long, hi long, first long, offset long")
    ranked = cut.join(base, ["source", "length"]).withColumn("rank", F.col("nth") + F.col("base"))
    at = F.broadcast(table.withColumnRenamed("length", "__length"))       # at most a few rows for each length up to the window
    return (ranked.join(at, (F.col("length") == F.col("__length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
            .withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("lo"))
            .drop("source", "nth", "base", "rank", "lo", "hi", "first", "__length"))


def sequences(placed: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, length, ids (the pieces' ids in order of offset) and its pieces."""
    part = F.struct("offset", "doc_id", "start", "length", "ids")
    return (placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(part)).alias("p"))
            .select("sequence_id", "length", F.expr("aggregate(p, cast('' as binary), (s, x) -> concat(s, x.ids))").alias("ids"),
                    F.transform("p", lambda x: F.struct(x["offset"], x["doc_id"], x["start"], x["length"])).alias("pieces")))
