"""Language identification by error-correcting output codes.

Each language gets a codeword of +1/-1 bits. For every bit a binary classifier over byte trigrams says
on which side a text lies; decoding sums each bit's logistic loss against every codeword, weighted by how
well that bit did in training, and the nearest codeword wins. A text whose two nearest codewords lie
within ``margin`` of each other is flagged ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import text as X

UNDETERMINED = "und"
BUCKETS = 1 << 13
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
          T.StructField("ambiguous", T.BooleanType())]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray        # languages x bits, +1 / -1
    weights: np.ndarray     # buckets x bits
    bias: np.ndarray        # bits
    bit_weight: np.ndarray  # bits
    margin: float


def codebook(k: int) -> np.ndarray:
    """Codewords for ``k`` languages: the exhaustive code up to six, else balanced random columns (fixed
    seed) keeping, of several draws, the one with the largest least distance."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 6:
        cols = [[1] + [1 if (c >> i) & 1 else -1 for i in range(k - 1)] for c in range(2 ** (k - 1) - 1)]
        return np.array(cols, float).T
    rng, best, far = np.random.RandomState(7), None, -1
    bits = int(np.ceil(12 * np.log2(k)))
    half = np.where(np.arange(k) % 2 == 0, 1.0, -1.0)
    for _ in range(64):
        m = np.stack([rng.permutation(half) for _ in range(bits)], axis=1)
        d = bits - np.max(m @ m.T - 2 * bits * np.eye(k))
        if d > far:
            best, far = m, d
    return best


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each byte trigram, offsets by document). A space stands before and after each text."""
    n = len(offs) - 1
    out_offs = offs + 2 * np.arange(n + 1)
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    place = np.ones(len(padded), bool)
    place[out_offs[:-1]] = False
    place[out_offs[1:] - 1] = False
    padded[place] = X.LOWER[data]
    padded[X.SPACE[padded]] = 32
    p = padded.astype(np.uint32)
    b = np.empty(len(p), np.uint32)
    b[:-2] = p[:-2] << 16 | p[1:-1] << 8 | p[2:]
    b[-2:] = 0                           # the two last positions of a text start no trigram of its own
    bucket = ((b * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int32)
    last = out_offs[1:]
    bucket[last - 1] = BUCKETS           # a spare row that weighs nothing
    bucket[last - 2] = BUCKETS
    return bucket, out_offs


def _feature_rows(batches):
    """Sparse trigram counts of each text: bucket numbers and counts, as bytes."""
    for b in batches:
        data, offs = X.utf8(b.column(2))
        ids, counts = [], []
        for i, j, d, o, begins, ends in X.stretches(data, offs):
            g, go = trigrams(d, o)
            for k in range(j - i):
                c = np.bincount(g[go[k]:go[k + 1]], minlength=BUCKETS + 1)[:BUCKETS]
                own = c if begins else own + c
                if ends:
                    at = np.flatnonzero(own)
                    ids.append(at.astype("<u2").tobytes())
                    counts.append(own[at].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
                                         names=["lang", "rank", "ids", "counts"])


def train(labelled: DataFrame, per_language: int = 256, margin: float = 0.5, steps: int = 120) -> Model:
    """Fit on at most ``per_language`` rows of each language of ``labelled`` (doc_id, text, lang): those with
    the smallest hash of doc_id, whole texts. Only their trigram counts come to the driver. Rows without
    text or lang are not learned from; without any row the model knows no language."""
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id")).alias("rank"),
                           F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    first = Window.partitionBy("lang").orderBy("rank")
    edge = (rows.select("lang", "rank").withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language)
            .groupBy("lang").agg(F.max("rank").alias("edge")))
    near = rows.join(F.broadcast(edge), "lang").where("rank <= edge").select("lang", "rank", "text")   # a row for each language
    feats = near.mapInArrow(_feature_rows, "lang string, rank long, ids binary, counts binary")
    got = (feats.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "ids", "counts")))
           .where(F.col("n") <= per_language).orderBy("lang", "n").collect())
    langs = sorted({r["lang"] for r in got})
    code = codebook(len(langs))
    bits = code.shape[1]
    if len(langs) < 2:
        return Model(langs, code, np.zeros((BUCKETS + 1, bits), np.float32), np.ones(bits), np.ones(bits), margin)
    x = np.zeros((len(got), BUCKETS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["ids"], "<u2")] = np.frombuffer(r["counts"], "<f4")
    x *= 100 / np.maximum(x.sum(1, keepdims=True), 1)
    which = np.array([langs.index(r["lang"]) for r in got])
    y = code[which].astype(np.float32)
    share = (1 / np.bincount(which)[which]).astype(np.float32)[:, None]
    share /= share.sum()
    w, b = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):        # Adam on the class-balanced logistic loss, all bits at once
        g = -y * share / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        gw = x.T @ g + 1e-5 * w
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.99 * m2 + 0.01 * gw * gw
        w -= 0.05 * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.99 ** t)) + 1e-8)
        b -= 0.5 * g.sum(0)
    right = (share * ((x @ w + b) * y > 0)).sum(0)
    full = np.vstack([w, np.zeros((1, bits), np.float32)])
    return Model(langs, code, full, b, np.clip(right, 0.05, 1), margin)


def one_language(margin: float = 0.0) -> Model:
    """A model with a single language without a name: a text is in it as soon as it has a letter."""
    code = codebook(1)
    bits = code.shape[1]
    return Model(["any"], code, np.zeros((BUCKETS + 1, bits), np.float32), np.zeros(bits), np.ones(bits), margin)


def scorer(model: Model):
    """The batch function: (lang, score, ambiguous) of each text. A text without a letter, an empty one
    and null give ``und`` with score 0."""
    k = len(model.languages)

    def score(col: pa.Array) -> list[pa.Array]:
        data, offs = X.utf8(col)
        n = len(offs) - 1
        margins = np.zeros((n, model.code.shape[1]))
        for i, j, d, o, _, _ in X.stretches(data, offs):
            g, go = trigrams(d, o)
            margins[i:j] += X.sums(np.take(model.weights, g, axis=0), go)
        margins = 100 * margins / np.maximum(np.diff(offs), 1)[:, None] + model.bias
        known = np.array([t is not None and any(map(str.isalpha, t)) for t in col.to_pylist()], bool) if k else np.zeros(n, bool)
        loss = np.log1p(np.exp(-np.clip(margins[:, None, :] * model.code, -30, 30))) @ model.bit_weight
        p = np.exp(loss.min(1, keepdims=True) - loss) if k else np.zeros((n, 1))
        p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
        best = p.argmax(1) if k else np.zeros(n, int)
        two = np.sort(loss, axis=1)[:, :2]
        close = (two[:, 1] - two[:, 0] < model.margin) if k > 1 else np.zeros(n, bool)
        lang = [model.languages[b] if u else UNDETERMINED for b, u in zip(best, known)]
        top = np.where(known, p.max(1), 0.0)
        return [pa.array(lang, pa.string()), pa.array(top, pa.float64()), pa.array(close & known)]

    return score


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` plus lang_pred, score (0 to 1) and ambiguous, one row per row.

    Null, empty and letterless texts get ``und``, score 0 and ambiguous false; repeated rows are scored
    alike; an empty table gives an empty table; columns outside ``keep`` and ``text`` are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)   # languages x bits x 8192 floats: bounded by the label set
    return X.append_columns(docs, keep, FIELDS, lambda: scorer(sent.value))
