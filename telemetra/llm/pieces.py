"""SentencePiece encoding and decoding in batches.

Distinct words of one length advance together: at every end position all substrings are hashed at once and probe the sorted
hashes of the pieces, and a vectorised maximum over the start positions is kept as backpointer. For a unigram model the maximum is of
summed scores (Viterbi). A BPE model has no such sum: there the last piece of a prefix is the one whose neighbour, the last piece
at its start position, would stay apart from it under the merges; exactly one candidate passes, so the maximum is over 0 and 1.
Both give the ids of the library for the same model file. BPE words of over 4096 characters (script without blanks) do not go through the
lattice: their merges are made in order from a heap, with the same ids.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import text as X

BLANK = 0x2581           # the sign that stands for a blank in pieces
UNKNOWN_PENALTY = 10.0   # fixed value: how far below the least score an unknown character lies
_models: dict[str, "Model"] = {}
_seen: dict[str, X.SpanIds] = {}        # spans already encoded, by model; a worker process keeps them from task to task
PAIRS = 1 << 20                         # pairs of pieces whose merge is remembered
LIKELY = 1 << 20                        # slots of the filter before the hashes of the pieces, which are sorted by slot
LONG = 4096                             # characters from which a word is merged on its own
RUN_BYTES = 2 << 20                     # bytes of text that are encoded together


class Model:
    """Pieces, scores and kind of a model file, with the tables that encoding and decoding need."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2
        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(proto)
        if m.normalizer_spec.name != "identity" or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models without normalisation, with a blank put before the text, are read")
        if m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are read")
        self.bpe = m.trainer_spec.model_type == 2
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.text = [p.piece for p in m.pieces]
        self.size = len(self.text)
        plain = [i for i, p in enumerate(m.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        self.score = np.array([p.score for p in m.pieces], float)
        self.unknown_score = float(min(self.score[plain], default=0.0)) - UNKNOWN_PENALTY
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN)
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        self.by_text = {self.text[i]: i for i in plain}
        self.longest = max((len(t) for t in self.by_text), default=1)
        codes = np.frombuffer("".join(self.by_text).encode("utf-32-le"), np.uint32)
        length = np.fromiter(map(len, self.by_text), np.int64, len(self.by_text))
        h = span_hash(codes, np.cumsum(length) - length, np.cumsum(length))
        ids = np.fromiter(self.by_text.values(), np.int64, len(self.by_text))
        slot = (h & np.uint64(LIKELY - 1)).astype(np.int64)
        order = np.argsort(slot)
        self.keys, self.ids = np.append(h[order], np.uint64(0)), np.append(ids[order], -1)
        slots, first, many = np.unique(slot[order], return_index=True, return_counts=True)
        self.first = np.full(LIKELY, -1, np.int32)         # by slot: place of its first piece, of at most ``probes``
        self.first[slots] = first
        self.probes = int(many.max(initial=1))
        if len(np.unique(h)) != len(h):
            raise ValueError("two pieces share a hash")
        long = [t for t in self.by_text if len(t) > 1]
        self.joins = np.zeros(0x110000, bool)              # characters that are part of a longer piece
        self.joins[[ord(c) for c in set("".join(long))]] = True
        self.cut_at_blank = not any(chr(BLANK) in t.lstrip(chr(BLANK)) for t in long)
        raw = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL else
               b" \xe2\x81\x87 " if p.type == kinds.UNKNOWN else p.piece.replace(chr(BLANK), " ").encode() for p in m.pieces]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.pair, self.pair_apart = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self._scores = self.score.tolist()
        # characters of every piece
        self.point = np.frombuffer("".join(self.text).encode("utf-32-le"), np.uint32)
        self.point_size = np.fromiter(map(len, self.text), np.int64, self.size)
        self.point_at = np.cumsum(self.point_size) - self.point_size
        # a piece's own merges, entered when it is first asked for: score of each, and before each the number of characters and the hash sum of
        # its first and of its last symbol; row ``size`` is for any character alone
        self.wide = self.longest + 1
        shape = (self.size + 1, self.wide)
        self.known, self.is_whole = np.zeros(self.size + 1, bool), np.zeros(self.size + 1, bool)
        self.step = np.full(shape, -np.inf)
        self.left, self.right = np.ones(shape, np.int16), np.ones(shape, np.int16)
        self.head, self.tail = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
        self.known[self.size] = self.is_whole[self.size] = True
        self.across = np.append(self.score, -np.inf)

    # -- merges -------------------------------------------------------------------------------------------------
    def merged(self, symbols: list[str]) -> list[str]:
        """BPE of a short run of characters: the best-scoring neighbours merge, the leftmost first."""
        symbols = list(symbols)
        while (found := self._next(symbols)) is not None:
            at = found[1]
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _next(self, symbols: list[str]) -> tuple[float, int] | None:
        """Score and place of the merge that comes next."""
        best, at = None, -1
        for k in range(len(symbols) - 1):
            i = self.by_text.get(symbols[k] + symbols[k + 1])
            if i is not None and (best is None or self._scores[i] > best):
                best, at = self._scores[i], k
        return None if best is None else (best, at)

    def merged_long(self, text: str) -> list[str]:
        """As ``merged``, in time that grows little faster than the text: neighbours wait in a heap, by score and place."""
        symbols: list[str | None] = list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(k: int, j: int) -> None:
            i = self.by_text.get(symbols[k] + symbols[j])
            if i is not None:
                heappush(heap, (-self._scores[i], k, len(symbols[k]) + len(symbols[j])))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, k, size = heappop(heap)
            j = after[k]
            # one of the two may have merged with another neighbour since
            if symbols[k] is None or j >= n or len(symbols[k]) + len(symbols[j]) != size:
                continue
            symbols[k] += symbols[j]
            symbols[j] = None
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                offer(k, after[k])
            if before[k] >= 0:
                offer(before[k], k)
        return [x for x in symbols if x is not None]

    def _merges(self, pieces: np.ndarray) -> np.ndarray:
        """Rows of the tables of a piece's own merges, which are made where they are lacking."""
        row = np.minimum(pieces, self.size)
        lacking = row[~self.known[row]]
        for p in np.unique(lacking).tolist() if len(lacking) else ():
            symbols, t, n = list(self.text[p]), 0, len(self.text[p])
            while True:
                self.left[p, t], self.right[p, t] = len(symbols[0]), len(symbols[-1])
                if (found := self._next(symbols)) is None:
                    break
                self.step[p, t], at = found
                symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
                t += 1
            code = X.mix(self.point[self.point_at[p]:self.point_at[p] + n].astype(np.uint64) + np.uint64(1))
            total = np.append(np.uint64(0), np.cumsum(code * X.powers(X.BASE, n)[:n]))
            begin = n - self.right[p, :t + 1].astype(np.int64)
            self.head[p, :t + 1] = total[self.left[p, :t + 1]]
            self.tail[p, :t + 1] = (total[n] - total[begin]) * X.powers(X.BASE_INV, n + 1)[begin]
            self.is_whole[p] = len(symbols) == 1
            self.known[p] = True
        return row

    def _stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges over the characters of two pieces end with these two. Until one crosses the border, each piece merges as
        it does alone, so all pairs step together: the best of the left piece's next merge, the one across, and the right's next is
        made (the leftmost of equals), and a pair leaves when that is the one across or none is left."""
        a, b = self._merges(left), self._merges(right)
        out = self.is_whole[a] & self.is_whole[b]
        power, salt = X.powers(X.BASE, self.wide), np.arange(2 * self.wide).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        step, head, tail, first, end = (x.ravel() for x in (self.step, self.head, self.tail, self.left, self.right))
        alone = max(left.max(initial=0), right.max(initial=0)) >= self.size
        go = np.flatnonzero(out)
        i, j = a[go] * self.wide, b[go] * self.wide
        while len(go):
            p, q, x, y = end[i], first[j], tail[i], head[j]
            if alone:
                x, y = (np.where(k >= self.size, X.mix(np.maximum(k - self.size, 0).astype(np.uint64) + np.uint64(1)), z) for k, z in ((left[go], x), (right[go], y)))
            across, own, other = self.across[self.find(X.mix(x + power[p] * y + salt[p + q]))], step[i], step[j]
            crossed = (across > own) & (across >= other)
            out[go[crossed]] = False
            mine = own >= other
            stay = np.flatnonzero(~crossed & np.isfinite(np.maximum(own, other)))
            mine = mine[stay]
            go, i, j = go[stay], i[stay] + mine, j[stay] + ~mine
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 where it is none's."""
        at = self.first[(h & np.uint64(LIKELY - 1)).astype(np.int64)]
        some = np.flatnonzero(at >= 0)
        out = np.full(len(h), -1, np.int64)
        at, some_h = at[some].astype(np.int64), h[some]
        for _ in range(self.probes):                       # another piece of the slot would be the next one
            true = self.keys[at] == some_h
            out[some[true]] = self.ids[at[true]]
            more = ~true & (at + 1 < len(self.ids) - 1)
            if not more.any():
                break
            some, at, some_h = some[more], at[more] + 1, some_h[more]
        return out

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two pieces stay two when the merges run over their characters; remembered by pair, in a table of fixed size where a
        newer pair may take an older one's place."""
        pair = left * (1 << 21) + right
        slot = (X.mix(pair.astype(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
        out, new = self.pair_apart[slot], np.flatnonzero(self.pair[slot] != pair)
        if len(new):
            which, first, back = np.unique(pair[new], return_index=True, return_inverse=True)
            found = self._stay(which >> 21, which & ((1 << 21) - 1))
            out[new] = found[back]
            at = slot[new][first]
            self.pair[at], self.pair_apart[at] = which, found
        return out

    # -- encoding -----------------------------------------------------------------------------------------------
    def lattice(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of one length (a row of code points each), word by word, and how many each has; ids from ``size`` on are
        unknown characters."""
        n, length = words.shape
        code = X.mix(words.astype(np.uint64) + np.uint64(1))
        power, inverse = X.powers(X.BASE, length), X.powers(X.BASE_INV, length + 1)
        total = np.zeros((n, length + 1), np.uint64)
        np.cumsum(code * power[:length], axis=1, out=total[:, 1:])
        rows = np.arange(n)
        score = np.full((n, length + 1), -np.inf)
        score[:, 0] = 0
        last = np.full((n, length + 1), -1, np.int64)
        back = np.zeros((n, length + 1), np.int64)
        for end in range(1, length + 1):
            first = max(0, end - self.longest)
            start = np.arange(first, end)
            h = X.mix((total[:, [end]] - total[:, first:end]) * inverse[first:end] + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
            piece = self.find(h.ravel()).reshape(h.shape)   # few substrings are pieces
            alone = piece[:, -1] < 0                        # a character that is no piece is a candidate all the same
            piece[alone, -1] = self.size + words[alone, end - 1]
            r, c = np.nonzero(piece >= 0)
            reached = np.isfinite(score[r, first + c])
            r, c = r[reached], c[reached]
            one = piece[r, c]
            gain = np.full(piece.shape, -np.inf)
            if self.bpe:
                before = last[r, first + c]
                good = before < 0
                good[~good] = self.apart(before[~good], one[~good])
                # at the start of the word the piece must be what the merges make of its own characters
                head = np.flatnonzero(before < 0)
                good[head] = self.is_whole[self._merges(one[head])]
                gain[r[good], c[good]] = 0
            else:
                own = np.where(one >= self.size, self.unknown_score, self.score[np.minimum(one, self.size - 1)])
                gain[r, c] = score[r, first + c] + own
            best = gain.argmax(1)
            score[:, end], last[:, end], back[:, end] = gain[rows, best], piece[rows, best], start[best]
        steps = []
        at, alive, count = np.full(n, length), rows, np.zeros(n, np.int64)
        while len(alive):
            steps.append((alive, last[alive, at[alive]]))
            count[alive] += 1
            at[alive] = back[alive, at[alive]]
            alive = alive[at[alive] > 0]
        ends = np.cumsum(count)
        out = np.empty(ends[-1] if n else 0, np.int64)
        for k, (r, p) in enumerate(steps):
            out[ends[r] - 1 - k] = p
        return out, count

    def words(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place of each word's first, their number), by groups of words of equal length."""
        at, size, flat, made = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), [], 0
        length = ends - starts
        for n in np.unique(length).tolist():
            group = np.flatnonzero(length == n)
            long = self.bpe and n > LONG
            for part in np.array_split(group, min(len(group), -(-len(group) * n // 200_000))):
                rows = points[starts[part][:, None] + np.arange(n)]
                found, count = self._long(rows) if long else self._checked(rows, *self.lattice(rows))
                found, count = self._spell(found, count)
                at[part], size[part] = made + np.cumsum(count) - count, count
                flat.append(found)
                made += len(found)
        return np.concatenate(flat) if flat else np.zeros(0, np.int64), at, size

    def _long(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of long words, merged one by one."""
        got = [[self.by_text.get(x, self.size + ord(x[0])) for x in self.merged_long(row.astype("<u4").tobytes().decode("utf-32-le"))] for row in rows]
        return np.array([p for g in got for p in g], np.int64), np.array([len(g) for g in got], np.int64)

    def _checked(self, rows: np.ndarray, found: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces whose characters are those of their words; others (two substrings with one hash: never seen, but not trusted) are made anew."""
        known = (found >= 0) & (found < self.size)
        p = np.where(known, found, 0)
        chars = np.where(known, self.point_size[p], 1)
        ends = np.concatenate([[0], np.cumsum(chars)])
        bound = np.concatenate([[0], np.cumsum(count)])
        own = np.repeat(np.where(known, self.point_at[p], 0) - ends[:-1], chars) + np.arange(ends[-1])
        text = self.point[own]
        text[ends[:-1][~known]] = np.maximum(found[~known] - self.size, 0)
        good = np.diff(ends[bound]) == rows.shape[1]
        if good.all():
            good = (text.reshape(rows.shape) == rows).all(1)
        else:
            for k in np.flatnonzero(good).tolist():
                good[k] = (text[ends[bound[k]]:ends[bound[k + 1]]] == rows[k]).all()
        if good.all():
            return found, count
        got = np.split(found, bound[1:-1])
        for k in np.flatnonzero(~good).tolist():
            got[k] = np.array([self.by_text.get(x, self.size + ord(x[0])) for x in self.merged(list(rows[k].astype("<u4").tobytes().decode("utf-32-le")))], np.int64)
        return np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got))

    def _spell(self, found: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """With unknown characters spelled."""
        unknown = np.flatnonzero(found >= self.size)
        if not len(unknown):
            return found, count
        spelled = [self.spelled(p - self.size) for p in found[unknown].tolist()]
        width = np.ones(len(found), np.int64)
        width[unknown] = [len(x) for x in spelled]
        ends = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(found, width)
        for k, x in zip(ends[unknown].tolist(), spelled):
            out[k:k + len(x)] = x
        return out, np.diff(ends[np.concatenate([[0], np.cumsum(count)])])

    def spelled(self, point: int) -> list[int]:
        """An unknown character as its bytes, or the unknown piece where the model has none."""
        return [self.byte[b] for b in chr(point).encode()] if len(self.byte) == 256 else [self.unknown]

    def encode(self, data: np.ndarray, offs: np.ndarray, seen: X.SpanIds, begins: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by document) of a run of documents in UTF-8, or of a later stretch of one (not ``begins``)."""
        _, raw, at = X.code_points(data, offs)
        n = len(offs) - 1
        full = np.flatnonzero(np.diff(at) > 0) if begins else np.zeros(0, np.int64)   # an empty text has no piece, also not the blank before it
        lead = np.zeros(n + 1, np.int64)
        lead[full + 1] = 1
        bound = at + np.cumsum(lead)
        points = np.full(len(raw) + len(full), BLANK, np.uint32)
        body = np.ones(len(points), bool)
        body[bound[full]] = False
        points[body] = np.where(raw == 32, BLANK, raw)
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        start = np.zeros(len(points), bool)
        start[bound[:-1][np.diff(bound) > 0]] = True
        joins = self.joins[points]
        start |= ~joins
        start[1:] |= ~joins[:-1]
        if self.cut_at_blank:
            start[1:] |= (points[1:] == BLANK) & (points[:-1] != BLANK)
        starts = np.flatnonzero(start)
        ids, total = seen.encode(points, starts, np.append(starts[1:], len(points)), lambda s, e: self.words(points, s, e))
        return ids, total[np.searchsorted(starts, bound)]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        """Texts of runs of ids: the pieces' bytes in a row, without the blank put before the text."""
        size = self.raw_size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        data = self.raw[np.repeat(self.raw_at[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
        at = total[offs].tolist()
        return [data[s + (data[s:s + 1] == b" "):e].decode("utf-8", "replace") if e > s else "" for s, e in zip(at[:-1], at[1:])]


def span_hash(points, starts, ends):
    return X.span_hashes(X.mix(points.astype(np.uint64) + np.uint64(1)), starts, ends)


def model(path: str) -> Model:
    """The model of a file, read once per worker."""
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = Model(f.read())
    return _models[path]


def encode_texts(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` plus pieces (array of ids) of every whole text. Null and empty texts have none; repeated rows
    are encoded alike; an empty table stays empty; other columns are not read."""
    def make():
        m, seen = model(path), _seen.setdefault(path, X.SpanIds())

        def run(col):
            data, offs = X.utf8(col)
            ids, ends = [], [np.zeros(1, np.int64)]
            for _, _, d, o, begins, done in X.stretches(data, offs, RUN_BYTES):
                got, at = m.encode(d, o, seen, begins)
                ids.append(got)
                at = at[1:] + ends[-1][-1]
                if begins:
                    ends.append(at)
                else:
                    ends[-1] = at
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            return [pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(flat.astype(np.int32)))]

        return run

    return X.append_columns(docs, keep, [T.StructField("pieces", T.ArrayType(T.IntegerType()))], make, text)


def decode_pieces(encoded: DataFrame, path: str, keep: list[str], pieces: str = "pieces") -> DataFrame:
    """``keep`` columns of ``encoded`` plus decoded, the text of its ids. Null counts as no ids; ids outside the model raise."""
    cols = [c for c in keep if c != "decoded"]
    src = encoded.select(*[F.col(f"`{c}`") for c in cols], F.coalesce(F.col(f"`{pieces}`").cast("array<int>"), F.array().cast("array<int>")).alias("__ids"))
    schema = T.StructType([src.schema[i] for i in range(len(cols))] + [T.StructField("decoded", T.StringType())])

    def run(batches):
        m = model(path)
        for b in batches:
            col = b.column(len(cols))
            offs = np.asarray(col.offsets)
            ids = np.asarray(col.values)[offs[0]:offs[-1]].astype(np.int64) if len(col) else np.zeros(0, np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= m.size):
                raise ValueError("an id is not one of the model's")
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(cols))] + [pa.array(m.decode(ids, offs - offs[0]), pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)
