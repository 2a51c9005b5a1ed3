"""Toxicity by nearest labelled examples: exact TF-IDF cosine over the words of whole texts.

Every word of the examples is a term, weighted by inverse document frequency and the logarithm of its count, and every example is a unit
vector of all its words; a word that no example holds counts in a text's length. In scripts written without blanks, neighbouring
characters stand for words. Rare words keep postings and are summed for all examples; words of many examples are held as
blocks of a dense table and, for each word and block, the largest weight. A text sums the blocks with the highest upper bounds, then those
whose bound could still change its nearest neighbours, which are therefore exact. Neighbours vote by similarity.

A few words among hundreds move a whole text's cosines little, so a text is searched twice: as a whole, and word by word. The nearest examples of a
word alone are those with its largest weights; they vote by similarity too, as a fixed number per word, and a text takes the words voted most
toxic. Both votes are weighed against each other and calibrated on the examples themselves, each left out in turn. Nothing but neighbours'
labels enters a score. Examples with just the text's words count by their labels.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from . import text as X

BLOCK = 64
FIRST = 4              # blocks summed before any is ruled out
COMMON = 0.05          # share of the examples from which on a word is held in the dense table
RUN, POSTINGS = 64, 1 << 20            # texts searched together, and about the most postings they sum at once
SLOT_BITS = 10         # hash slots in which labels are counted to find the last one that can be chosen
TELLING = 3            # words of a text, those voted most toxic, that count
WORD_K, PRIOR = 50, 3  # nearest examples of one word, and votes at the general rate that stand beside theirs
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType())), T.StructField("similarity", T.ArrayType(T.DoubleType()))]


def word_keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of every run of letters and digits; a key is the hash of the whole run. A run with characters of a
    script without blanks gives its pairs of neighbouring characters instead."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, ends, doc = _runs(LETTER[data], offs)
    total = np.concatenate([[0], np.cumsum(_unspaced(data))])
    wide = np.flatnonzero(total[ends] > total[starts])
    if len(wide):
        at = np.flatnonzero((data & 0xC0) != 0x80)                           # first bytes of characters
        lo, hi = np.searchsorted(at, starts[wide]), np.searchsorted(at, ends[wide])
        size = np.maximum(hi - lo - 1, 1)
        place = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        after = np.append(at, [len(data)] * 2)
        s2, e2 = at[place], np.minimum(after[place + 2], np.repeat(ends[wide], size))
        rest = np.setdiff1d(np.arange(len(starts)), wide)
        starts, ends, doc = (np.concatenate([a[rest], b]) for a, b in ((starts, s2), (ends, e2), (doc, np.repeat(doc[wide], size))))
    return doc, X.span_hashes(X.BYTE_CODE[X.LOWER[data]], starts, ends)


def _unspaced(data: np.ndarray) -> np.ndarray:
    """Whether a byte begins a character of Han, Kana, Thai, Lao, Burmese or Khmer."""
    after = np.append(data[1:], 0)
    return ((data >= 0xE3) & (data <= 0xE9) | (data == 0xE0) & (after >= 0xB8) & (after <= 0xBB) | (data == 0xE1) & ((after >= 0x80) & (after <= 0x82) | (after == 0x9E) | (after == 0x9F))
            | (data == 0xF0) & (after >= 0xA0) & (after <= 0xBF))


def _runs(inside: np.ndarray, offs: np.ndarray):
    """Starts, ends and documents of the runs of True."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offs, starts, "right") - 1


def counted(data: np.ndarray, offs: np.ndarray):
    """Runs of whole documents: (first, last + 1, document, key, count), one entry for each distinct word of a document, by document."""
    found = []
    for i, j, d, o, _, last in X.stretches(data, offs):
        doc, key = word_keys(d, o)
        every, which = np.unique(key, return_inverse=True)
        cell, count = np.unique(doc * max(len(every), 1) + which, return_counts=True)
        found.append((cell // max(len(every), 1), every[cell % max(len(every), 1)] if len(every) else every, count))
        if last:
            doc, key, count = (np.concatenate(x) for x in zip(*found))
            if len(found) > 1:                               # one document, stretch by stretch
                key, which = np.unique(key, return_inverse=True)
                doc, count = np.zeros(len(key), np.int64), np.bincount(which, count, len(key)).astype(np.int64)
            found = []
            yield i, j, doc, key, count


def _example_rows(batches):
    """Keys and counts of each example's words, as bytes."""
    for b in batches:
        keys, counts = [], []
        for i, j, doc, key, count in counted(*X.utf8(b.column(3))):
            at = np.searchsorted(doc, np.arange(j - i + 1))
            for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
                keys.append(key[s:e].astype("<u8").tobytes())
                counts.append(count[s:e].astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "label", "rank", "keys", "counts"])


@dataclass
class Index:
    keys: np.ndarray       # sorted keys of all words of the examples
    idf: np.ndarray
    says: np.ndarray       # vote of a word's own nearest examples, in logits above the general rate
    post_doc: np.ndarray   # postings of all words, by word, then example
    post_weight: np.ndarray
    edge: np.ndarray       # word -> bounds of its postings
    row: np.ndarray        # word -> row in the dense table, -1 for rare words
    ids: np.ndarray
    label: np.ndarray
    weight: np.ndarray     # of an example in the vote: its class's share in all labels over that in the sample
    block: int
    k: int
    mix: np.ndarray        # constant and weights of the whole text's vote and its words' votes
    steps: np.ndarray      # calibration: mixed vote (ascending) -> probability
    prob: np.ndarray
    empty: float           # probability of a text without neighbours

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("dense", "most")}     # made again where they are used

    @property
    def blocks(self) -> int:
        return -(-len(self.ids) // self.block)

    @cached_property
    def dense(self) -> np.ndarray:
        """Weights of the common words: block x word x example."""
        common = np.flatnonzero(self.row >= 0)
        out = np.zeros((self.blocks, len(common), self.block))
        for r, (s, e) in enumerate(self.edge[common].tolist()):
            d = self.post_doc[s:e]
            out[d // self.block, r, d % self.block] = self.post_weight[s:e]
        return out

    @cached_property
    def most(self) -> np.ndarray:
        """Largest weight by common word and block."""
        return np.ascontiguousarray(self.dense.max(2).T)

    def unit(self, doc: np.ndarray, idf: np.ndarray, count: np.ndarray, many: int) -> np.ndarray:
        w = idf * (1 + np.log(count))
        return w / np.sqrt(np.maximum(np.bincount(doc, w * w, many), 1e-24))[doc]

    def search(self, doc: np.ndarray, terms: np.ndarray, q: np.ndarray, many: int, skip: np.ndarray | None = None):
        """(examples, cosines) of the k nearest of each of ``many`` texts, whose words ``terms`` come by ``doc`` with weights ``q``. Each text's
        example ``skip`` is left out."""
        bound = np.searchsorted(doc, np.arange(many + 1))
        size = np.concatenate([[0], np.cumsum(np.where(self.row[terms] < 0, self.edge[terms, 1] - self.edge[terms, 0], 0))])[bound]
        i = 0
        while i < many:
            j = min(max(i + 1, int(np.searchsorted(size, size[i] + POSTINGS, "right")) - 1), i + RUN, many)
            s, e = bound[i], bound[j]
            yield from self._run(doc[s:e] - i, terms[s:e], q[s:e], j - i, None if skip is None else skip[i:j])
            i = j

    def _run(self, doc, terms, q, m, skip):
        wide, row = self.blocks * self.block, self.row[terms]
        rare = row < 0
        first, size = self.edge[terms[rare], 0], self.edge[terms[rare], 1] - self.edge[terms[rare], 0]
        done = np.cumsum(size)
        at = np.repeat(first - done + size, size) + np.arange(done[-1] if len(done) else 0)
        sim = np.bincount(np.repeat(doc[rare] * wide, size) + self.post_doc[at], self.post_weight[at] * np.repeat(q[rare], size), m * wide).astype(float, copy=False)
        sim = sim.reshape(m, self.blocks, self.block)
        table = np.zeros((m, self.dense.shape[1]))
        table[doc[~rare], row[~rare]] = q[~rare]
        bound = sim.max(2) + table @ self.most                # rare words are summed already, common ones by their block maxima
        own = () if skip is None else (np.arange(m), skip // self.block, skip % self.block)
        first = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]
        summed = np.zeros((m, self.blocks), bool)
        np.put_along_axis(summed, first, True, 1)
        self._add(sim, table, summed)
        if skip is not None:
            sim[own] = 0
        have = np.take_along_axis(sim, first[:, :, None], 1).reshape(m, -1)
        least = np.partition(have, have.shape[1] - self.k, axis=1)[:, have.shape[1] - self.k] if have.shape[1] >= self.k else np.zeros(m)
        more = ~summed & (bound >= np.maximum(least, 1e-12)[:, None] - 1e-9)
        self._add(sim, table, more)
        if skip is not None:
            sim[own] = 0
        sim[~(summed | more)] = 0
        sim = sim.reshape(m, wide)
        last = np.partition(sim, wide - self.k, axis=1)[:, wide - self.k] if wide >= self.k else np.zeros(m)
        for r in range(m):
            d = np.flatnonzero((sim[r] >= last[r] - 2e-9) & (sim[r] > 1e-12))
            s = sim[r, d]
            best = np.lexsort((d, -np.round(s, 9)))[:self.k]
            yield d[best], s[best]

    def _add(self, sim: np.ndarray, table: np.ndarray, wanted: np.ndarray) -> None:
        """Sum the common words of each text over its wanted blocks."""
        for b in np.flatnonzero(wanted.any(0)):
            r = np.flatnonzero(wanted[:, b])
            sim[r, b] += table[r] @ self.dense[b]

    def nearest(self, terms: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest to a text of these words, each there once, most similar first, ties by example number; cosine 0 is no
        neighbour."""
        doc = np.zeros(len(terms), np.int64)
        return next(self.search(doc, terms, self.unit(doc, self.idf[terms], np.ones(len(terms)), 1), 1, None if skip < 0 else np.array([skip])))

    def vote(self, d: np.ndarray, s: np.ndarray) -> float:
        """Similarity-weighted share of toxic neighbours; the nearer the heavier, an equal one far more than all others."""
        w = self.weight[d] * s * s / (1.01 - np.minimum(s * s, 1))
        return float((w * self.label[d]).sum() / w.sum())

    def calibrated(self, vote: float) -> float:
        return float(self.prob[min(np.searchsorted(self.steps, vote - 1e-12), len(self.prob) - 1)])

    def probability(self, d: np.ndarray, s: np.ndarray, says: float) -> float:
        """Of toxic, from the neighbours of the text and of its words; examples with the text's own words and counts are as many observations beside this one."""
        if not len(d):
            return self.empty
        same = self.label[d[s > 1 - 1e-9]]
        return float((self.calibrated(self.mix @ [1, self.vote(d, s), says]) + same.sum()) / (1 + len(same)))


def word_votes(word: np.ndarray, weight: np.ndarray, toxic: np.ndarray, share: np.ndarray, df: np.ndarray, rate: float, k: int = WORD_K) -> tuple[np.ndarray, np.ndarray]:
    """(by word, by posting without the posting's own example): vote of the k examples with the largest weights of the word, which are the nearest
    to it alone; ties by posting. ``word`` ascends; ``toxic`` and ``share`` are label and vote weight of the postings' examples. The similarity-weighted share
    of toxic is shrunk by PRIOR votes at ``rate``, and given in logits above that; 0 at least."""
    by = np.lexsort((-weight, word))
    edge = np.concatenate([[0], np.cumsum(df)])
    t, w = word[by], (weight * share)[by]
    bad = w * toxic[by]
    head = np.arange(len(by)) - edge[t] < k

    def logit(bad, all_, n):
        v = (np.where(n > 0, bad / np.maximum(all_, 1e-24), 0) * n + PRIOR * rate) / (n + PRIOR)
        return np.maximum(np.log(v / (1 - v) / (rate / (1 - rate))), 0)

    votes, against = np.bincount(t[head], w[head], len(df)), np.bincount(t[head], bad[head], len(df))
    spare = np.minimum(edge[:-1] + k, len(by) - 1)            # who comes in where one of the k is left out
    more = (df > k)[t] & head
    left, left_bad = votes[t] - w * head + np.where(more, w[spare[t]], 0), against[t] - bad * head + np.where(more, bad[spare[t]], 0)
    without = np.empty(len(by))
    without[by] = logit(left_bad, left, np.minimum(df[t] - 1, k))
    return logit(against, votes, np.minimum(df, k)), without


def _evidence(doc: np.ndarray, says: np.ndarray, many: int) -> np.ndarray:
    """Sum of the votes of each text's most telling words; ``doc`` ascends."""
    order = np.lexsort((-says, doc))
    nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
    return np.bincount(doc, np.where(nth < TELLING, says[order], 0), many)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Constant and weights of a regression with a small penalty; no weight is negative."""
    a, w = np.column_stack([np.ones(len(x)), x]), w / w.mean()
    c = np.zeros(a.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(c)), a.T @ (w * (y - p)) - 0.1 * c)
        c = c + step / max(1.0, np.abs(step).max() / 4)
    c[1:] = np.maximum(c[1:], 0)
    return c


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing steps that fit y best (pool adjacent violators): (upper bound of each step, value)."""
    order = np.argsort(x, kind="stable")
    steps: list[list[float]] = []
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist()):
        steps.append([a, b * c, c])
        while len(steps) > 1 and (steps[-2][0] == steps[-1][0] or steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]):
            u, v, t = steps.pop()
            steps[-1] = [u, steps[-1][1] + v, steps[-1][2] + t]
    return np.array([s[0] for s in steps]), np.array([s[1] / s[2] for s in steps])


def train(docs: DataFrame, labels: DataFrame, learn: Column, toxic: int = 3000, clean: int = 3000, block: int = BLOCK, k: int = 15) -> Index | None:
    """Index of at most ``toxic`` + ``clean`` labelled examples: of each class the labels with the smallest hash of doc_id, whole
    texts. Only the keys and numbers of their words come to the driver. Labels whose class is null or ``learn`` (a condition on doc_id) is
    false are not read; without examples of both classes there is no index."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(learn & F.col("label").isin(0, 1))
    known = known.withColumn("rank", F.xxhash64("doc_id")).withColumn("slot", F.shiftright("rank", 64 - SLOT_BITS))
    wanted, total, last = {0: clean, 1: toxic}, {}, {}
    for r in known.groupBy("label", "slot").agg(F.count(F.lit(1)).alias("n")).orderBy("label", "slot").collect():    # at most 2 * 2 ** SLOT_BITS rows
        if total.get(r["label"], 0) < wanted[r["label"]]:
            last[r["label"]] = r["slot"]
        total[r["label"]] = total.get(r["label"], 0) + r["n"]
    if len(total) < 2:
        return None
    of = lambda by: F.when(F.col("label") == 1, by[1]).otherwise(by[0])
    first = F.row_number().over(Window.partitionBy("label").orderBy("rank", "doc_id"))      # cut to ``most`` in every partition, then over all
    most = max(toxic, clean)
    chosen = (known.where(F.col("slot") <= of(last)).withColumn("nth", first).where(F.col("nth") <= most).where(F.col("nth") <= of(wanted))
              .select("doc_id", "label", "rank"))
    near = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")   # at most toxic + clean rows
    rows = near.select("doc_id", "label", "rank", "text").mapInArrow(_example_rows, T.StructType([docs.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("rank", T.LongType()),
                                                                                                   T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType())]))
    got = rows.withColumn("nth", first).where(F.col("nth") <= most).orderBy("label", "rank", "doc_id").collect()
    if len({r["label"] for r in got}) < 2:
        return None
    return build([r["doc_id"] for r in got], np.array([r["label"] for r in got]), [np.frombuffer(r["keys"], "<u8") for r in got],
                 [np.frombuffer(r["counts"], "<u4") for r in got], total, block, k)


def build(ids: list, label: np.ndarray, keys: list[np.ndarray], counts: list[np.ndarray], total: dict[int, int], block: int, k: int) -> Index:
    """Weigh and index all words of the examples, and calibrate."""
    n = len(ids)
    every, term = np.unique(np.concatenate(keys), return_inverse=True)
    owner = np.repeat(np.arange(n), [len(x) for x in keys])
    count = np.concatenate(counts).astype(np.int64)
    df = np.bincount(term, minlength=len(every))
    idf = np.log((1 + n) / (1 + df)) + 0.1
    row = np.full(len(every), -1)
    common = np.flatnonzero(df > COMMON * n)
    row[common] = np.arange(len(common))
    lead = np.full(n, len(common))                            # like examples side by side: tight block bounds
    often = np.flatnonzero(row[term] >= 0)
    often = often[np.lexsort((idf[term[often]] * (1 + np.log(count[often])), owner[often]))]
    lead[owner[often]] = row[term[often]]                     # the heaviest common word comes last and stays
    order = np.lexsort((np.arange(n), lead))
    place = np.argsort(order)
    label, owner = label[order], place[owner]
    size = np.bincount(label, minlength=2)
    share = np.array([total.get(0, 0) / max(size[0], 1), total.get(1, 0) / max(size[1], 1)])[label]
    by = np.lexsort((owner, term))
    bounds = np.concatenate([[0], np.cumsum(df)])
    ix = Index(every, idf, np.zeros(0), owner[by], np.zeros(0), np.stack([bounds[:-1], bounds[1:]], 1), row, np.array(ids)[order], label, share,
               block, k, np.zeros(3), np.zeros(1), np.zeros(1), 0.0)
    weight = ix.unit(owner, idf[term], count, n)
    ix.post_weight = weight[by]
    general = float((share * label).sum() / share.sum())
    ix.says, without = word_votes(term[by], ix.post_weight, label[owner[by]], share[owner[by]], df, general)
    alone = np.empty(len(by))
    alone[by] = without
    own = np.lexsort((term, owner))                           # each example as a text, without itself
    o, t = owner[own], term[own]
    says = _evidence(o, alone[own], n)
    votes, has = np.zeros(n), np.zeros(n, bool)
    for i, (d, s) in enumerate(ix.search(o, t, weight[own], n, np.arange(n))):
        has[i] = len(d) > 0
        votes[i] = ix.vote(d, s) if len(d) else 0.0
    rate = lambda m: float(((share * label)[m].sum() + 0.5 * share.mean()) / (share[m].sum() + 5 * share.mean()))
    ix.empty = rate(~has)
    if has.any():
        x, y = np.column_stack([votes, says])[has], label[has].astype(float)
        ix.mix = _logistic(x, y, share[has])
        ix.steps, ix.prob = isotonic(ix.mix[0] + x @ ix.mix[1:], y, share[has])
    return ix


def scorer(ix: Index | None):
    """The batch function: (score, evidence, similarity) of each text."""
    def score(col: pa.Array) -> list[pa.Array]:
        data, offs = X.utf8(col)
        n = len(offs) - 1
        if ix is None:
            return [pa.array(np.zeros(n)), pa.array([[]] * n, pa.list_(pa.int64())), pa.array([[]] * n, pa.list_(pa.float64()))]
        out, evidence, near = [], [], []
        absent = np.log(1 + len(ix.ids)) + 0.1               # idf of a word that no example holds
        for i, j, doc, key, count in counted(data, offs):
            at = np.minimum(np.searchsorted(ix.keys, key), max(len(ix.keys) - 1, 0))
            hit = ix.keys[at] == key if len(ix.keys) else np.zeros(len(key), bool)
            idf = np.full(len(key), absent)
            idf[hit] = ix.idf[at[hit]]
            q = ix.unit(doc, idf, count, j - i)[hit]
            doc, term = doc[hit], at[hit]
            says = _evidence(doc, ix.says[term], j - i)
            for (d, s), e in zip(ix.search(doc, term, q, j - i), says.tolist()):
                out.append(ix.probability(d, s, e))
                evidence.append(ix.ids[d[:5]].tolist())
                near.append(np.minimum(s[:5], 1).tolist())
        return [pa.array(out, pa.float64()), pa.array(evidence, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.float64()))]

    return score


def score_toxicity(docs: DataFrame, index: Index | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` plus score (0 to 1), evidence (ids of up to five nearest examples) and their similarity.

    Texts without a word that an example holds, null and empty ones among them, get the rate of such examples; repeated rows are scored alike; without an index every score
    is 0; an empty table stays empty; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(index)    # bounded by the words of the examples
    return X.append_columns(docs, keep, FIELDS, lambda: scorer(sent.value))
