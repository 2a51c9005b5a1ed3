"""Vectorised handling of Arrow text batches: bytes, words, spans and their hashes.

Everything here works on one bounded run of documents inside a task; Spark decides what a task sees.
Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``, which for UTF-8 is the same as runs of
code points outside that set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32                      # A-Z only
CHUNK_BYTES = 1 << 18

_rng = np.random.RandomState(20240131)
_MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15               # odd, so it has an inverse modulo 2**64
BASE_INV = pow(BASE, -1, 1 << 64)
BYTE_CODE = (_rng.randint(0, 1 << 32, 256, dtype=np.uint64) << np.uint64(32)
             | _rng.randint(0, 1 << 32, 256, dtype=np.uint64)) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**k`` modulo 2**64 for k < n (at least), kept per worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``codes`` (uint64): a polynomial from one running sum, then mixed
    with the length. Two different spans share a hash with probability about 2**-64."""
    n = len(codes)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * powers(BASE, n)[:n], out=total[1:])
    h = (total[ends] - total[starts]) * powers(BASE_INV, n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty. The offsets start at 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def chunks(data: np.ndarray, offs: np.ndarray, limit: int = CHUNK_BYTES):
    """Runs of whole documents of about ``limit`` bytes (one document when that is longer):
    (first, last + 1, bytes, offsets)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def stretches(data: np.ndarray, offs: np.ndarray, limit: int = CHUNK_BYTES):
    """As ``chunks``, but a document of more than two runs comes in stretches: (first, last + 1, bytes, offsets, whether it
    begins its document, whether it ends it). A stretch after the first starts with a blank (0x20) that follows
    something else than white space; where the text has no such place the stretch goes on."""
    for i, j, d, o in chunks(data, offs, limit):
        if len(d) <= 2 * limit:
            yield i, j, d, o, True, True
            continue
        s = 0
        while s < len(d):
            e = s + limit
            while True:                              # look for the place run by run
                w = d[e - 1:e + limit]
                at = np.flatnonzero((w[1:] == 32) & ~SPACE[w[:-1]])
                if len(at) or e + limit >= len(d):
                    break
                e += limit
            e = e + int(at[0]) if len(at) else len(d)
            yield i, j, d[s:e], np.array([0, e - s]), s == 0, e == len(d)
            s = e


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of every word."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    first = offs[:-1]
    before[first[first < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = offs[1:]
    after[last[last > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def sums(values: np.ndarray, offs: np.ndarray, kind=None) -> np.ndarray:
    """Sum of ``values`` over each [offs[i], offs[i+1]); empty ranges give zero."""
    kind = kind or values.dtype
    out = np.zeros((len(offs) - 1,) + values.shape[1:], kind)
    full = np.flatnonzero(offs[1:] > offs[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offs[:-1][full], axis=0, dtype=kind)
    return out


def code_points(data: np.ndarray, offs: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """(text, code points, offsets in code points) of a run of UTF-8 documents."""
    whole = data.tobytes().decode("utf-8")
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    return whole, points, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]


class SpanIds:
    """Ids of distinct text spans, remembered by hash: arrays sorted by hash, emptied beyond ``limit`` spans."""

    def __init__(self, limit: int = 1 << 20):
        self.limit = limit
        self._forget()

    def _forget(self):
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans in order, how many of them up to each span). ``encode(starts, ends)`` gives a list of id lists,
        or (ids, place of each span's first, their number), and is called once, with the first place of every span that is not remembered."""
        h = span_hashes(mix(points.astype(np.uint64) + np.uint64(1)), starts, ends)
        distinct, where, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > self.limit:
            self._forget()
        p = np.searchsorted(self.known, distinct)
        have = np.zeros(len(distinct), bool)
        inside = p < len(self.known)
        have[inside] = self.known[p[inside]] == distinct[inside]
        new = np.flatnonzero(~have)
        if len(new):
            got = encode(starts[where[new]], ends[where[new]])
            if isinstance(got, tuple):
                ids, at, size = got
            else:
                size = np.fromiter(map(len, got), np.int64, len(got))
                ids, at = np.array([i for g in got for i in g], np.uint32), np.cumsum(size) - size
            at = at + len(self.ids)
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
            self.known, self.at, self.size = (np.insert(x, p[new], y) for x, y in ((self.known, distinct[new]), (self.at, at), (self.size, size)))
        slot = np.searchsorted(self.known, distinct)
        at, size = self.at[slot][which], self.size[slot][which]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(at - total[:-1], size) + np.arange(total[-1])], total


def append_columns(df: DataFrame, keep: list[str], fields: list[T.StructField], make, text: str = "text") -> DataFrame:
    """``keep`` columns of ``df`` plus ``fields``, which ``make()(texts)`` computes for each Arrow batch.

    ``make`` runs once per task and returns the batch function. A kept column that has the name of a new
    field is replaced by it; other columns of ``df``, whatever their names, are not read.
    """
    new = {f.name for f in fields}
    cols = [c for c in keep if c not in new]
    own = text in cols
    src = df.select(*[F.col(f"`{c}`") for c in cols], *([] if own else [F.col(f"`{text}`").cast("string").alias("__text")]))
    at = cols.index(text) if own else len(cols)
    schema = T.StructType([src.schema[i] for i in range(len(cols))] + fields)
    names = cols + [f.name for f in fields]

    def run(batches):
        fn = make()
        for b in batches:
            pa.default_memory_pool().release_unused()      # what the last batch left
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(cols))] + fn(b.column(at)), names=names)

    return src.mapInArrow(run, schema)
