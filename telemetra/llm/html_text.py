"""Main text of web pages by suffix arrays of their hosts.

A page is cut into blocks in page order; the words of all its blocks, the article's too, are its token stream. The streams of a host are taken together and their
suffixes sorted: neighbours that share at least ``run`` leading words and come from distinct pages are repeated substrings, and the words that those cover are
boilerplate. A block goes when most of its words are covered; unique runs stay. An exact check follows, by what the markup itself says: covered blocks of an ``article``
(or ``main``) come back, as articles are copied and quote each other, and what is named as menus, headers, footers, sidebars, notices, adverts, forms or reader
comments goes, also where a host has one page only. Pages of a host whose whole visible text is equal count as one page, so copies do not cover each other.

Scale. Most suffixes have no neighbour that shares their leading words, so these are found first: each suffix sends three bytes of a hash of its host and leading words to
one of 4096 buckets, and hashes that come twice are marked in a bitmap of fixed size. Suffixes that are not marked occur once and need no sorting; no repeated one is
missed, and one that is marked by chance is told apart by the sort. The others are dealt by ranges of (leading words, stream), which is the order of the array. Runs
of equal leading words that end or begin an Arrow batch are compared by one summary row a batch. No host, run or page set is collected in one place. The bitmap lets
more through as more is repeated: 268 million marks, so beyond some hundred million distinct repeated substrings most suffixes are sorted.
The page's text goes to its covers as one compressed value a page, with the places of the blocks that they decide on.

Defined results: null or empty html has an empty text. Character references are decoded as in HTML 5, unknown ones stay as written. White
space inside a block, ``br`` included, is one space; empty blocks do not count. Unclosed comments, scripts and tags end with the page. Pages without
a usable url share the host with the empty name. Repeated rows are rows of their own. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .tables import stored

RUN = 6                                 # words that a repeated substring has at least
WORD = 4                                # bytes of a word's code in a suffix, which the host's name enters
KEY = RUN * WORD                        # bytes of a suffix: codes of the leading words
BUCKETS = 1 << 12                       # of hashes of suffixes; the rest of a hash is 24 bits, of which
MARKS = 1 << 16                         # the first 16 have a mark in the bucket's part of the bitmap
FLUSH = 1 << 22                         # hashes that a task holds at once
PLACES = 1 << 18                        # suffixes in a batch
GROUP = 1 << 18                         # characters of pages whose words are hashed together, to the last one's end
PART = 1 << 16                          # bytes of a text whose words are hashed together
CHARS = 1 << 22                         # characters of texts in a batch of results

# Fixed values of HTML: elements that begin a block, that have no end tag, and whose content is no markup.
BLOCKS = frozenset(("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th "
                    "thead tr ul").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|iframe|xmp|noembed|noframes"
# Elements of which the next one ends an open one.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
# Elements, roles and words of class or id that name what surrounds the text.
NAMED = frozenset("nav footer aside form menu dialog button select option label fieldset input search template canvas object audio video svg".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())
WORDS = frozenset(("nav navbar navigation menu menus menubar topbar toolbar breadcrumb breadcrumbs pagination pager masthead sidebar sidebars aside rail footer footers colophon "
                   "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner banners cookie cookies consent gdpr notice notices popup popups modal overlay newsletter "
                   "subscribe subscription signup login search searchbox form comment comments disqus respond replies reply share sharing social related recommended widget widgets skip").split())
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
HEADS = frozenset("header head".split())             # in an article a header may hold its title
PREFIXES = frozenset("has with without no is js".split())        # "has-sidebar" is said of what stands beside one
UNNAMED = frozenset("html body main h1 h2 h3 h4 h5 h6".split())  # their class says nothing of the kind

_ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+"
_MARK = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<({RAW})(?=[\s/>]){_ATTRIBUTES}>(?:.*?</\1(?=[\s/>])[^>]*+(?:>|\Z)|.*\Z)"
                   rf"|<(/?)([a-z][^\s/>]*+)({_ATTRIBUTES})>|<[!?/][^>]*+(?:>|\Z)|<[a-z][^>]*+\Z", re.S | re.I)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HOST = re.compile(r"[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    """Lower-cased host of a url; empty where there is none."""
    found = _HOST.match(url or "")
    return found.group(1).lower() if found else ""


def is_named(element: str, attributes: str, in_article: bool) -> bool:
    """Whether an element names itself as surroundings of the text."""
    if element in NAMED or (element in HEADS and not in_article):
        return True
    if element in UNNAMED or "=" not in attributes:
        return False
    words = COMMENTS if element == "article" else WORDS if in_article else WORDS | HEADS
    for what, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if what.lower() == "role":
            if value.strip().lower() in ROLES:
                return True
            continue
        for name in value.split():
            parts = [p.lower() for p in _PARTS.findall(name)]
            if parts and parts[0] not in PREFIXES and not words.isdisjoint(parts):
                return True
    return False


_is_named = lru_cache(1 << 14)(is_named)

ARTICLE, SURROUNDINGS, OPEN = 0, 1, 2


def blocks(page: str) -> list[tuple[str, int]]:
    """The page's blocks in order, as (text, kind): of the article, named as surroundings, or open."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool]] = []                  # open elements, and whether they name surroundings
    count: dict[str, int] = {}
    held: list[str] = []
    named = 0

    def flush():
        if not held:
            return
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            # 3: in main only; that is the article where the page has no other
            out.append((text, SURROUNDINGS if named else ARTICLE if count.get("article") else 3 if count.get("main") else OPEN))

    def pop():
        nonlocal named
        element, surrounds = stack[-1]
        if surrounds:
            flush()
        stack.pop()
        count[element] -= 1
        named -= surrounds

    def end(element: str):
        if not count.get(element):
            return
        if element not in BLOCKS:                       # an inline end tag closes no block
            k = len(stack) - 1
            while stack[k][0] != element:
                if stack[k][0] in BLOCKS:
                    return
                k -= 1
        while stack[-1][0] != element:
            pop()
        pop()

    at = 0
    for m in _MARK.finditer(page):
        start, stop = m.span()
        if start > at:
            held.append(page[at:start])
        at = stop
        _, closes, element, attributes = m.groups()
        if element is None:
            continue
        element = element.lower()
        if element in BLOCKS:
            flush()
        if closes:
            end(element)
            continue
        if element == "br":
            held.append(" ")
        if element in VOID or (element == "svg" and attributes.endswith("/")):
            continue
        if element == "body":
            while stack:
                pop()
        elif element in BLOCKS:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] not in BLOCKS:
                k -= 1
            if k >= 0 and (stack[k][0] == "p" or stack[k][0] in SIBLINGS.get(element, ())):
                while len(stack) > k:
                    pop()
        surrounds = (_is_named if len(attributes) < 256 else is_named)(element, attributes, bool(count.get("article")))
        if surrounds:
            flush()
        stack.append((element, surrounds))
        count[element] = count.get(element, 0) + 1
        named += surrounds
    if at < len(page):
        held.append(page[at:])
    flush()
    main = OPEN if any(kind == ARTICLE for _, kind in out) else ARTICLE
    return [(text, main if kind == 3 else kind) for text, kind in out]


def stream_id(host: str, cut: list[tuple[str, int]]) -> int:
    """Names a page's whole visible text. Pages of a host with equal text have one id."""
    return xxhash.xxh3_64_intdigest("\n".join(t for t, _ in cut), xxhash.xxh64_intdigest(host)) - (1 << 63)


def _mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers, well spread."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _weights(n: int) -> np.ndarray:
    """A factor for each byte of a word."""
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_WEIGHTS = _weights(256)


def _word_hashes(text: bytes) -> np.ndarray:
    """Sums of each word's bytes by the factors of their places; words are parted by one space."""
    b = np.frombuffer(text, np.uint8)
    ends = np.append(np.flatnonzero(b == 32), len(b))
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts
    place = np.arange(len(b)) - np.repeat(starts, sizes + 1)[:-1]
    longest = int(sizes.max()) + 1
    terms = (_WEIGHTS if longest <= len(_WEIGHTS) else _weights(longest))[place] * (b.astype(np.uint64) + np.uint64(1))
    terms[ends[:-1]] = 0
    return np.add.reduceat(terms, starts)


def streams(pages: list[tuple[str, list[tuple[str, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all words of pages (host, blocks), one page after the other, and where each page's begin and the last one's end."""
    lines = [" ".join([t for t, _ in cut]) for _, cut in pages]
    sizes = [line.count(" ") + 1 if line else 0 for line in lines]
    sites = np.repeat(np.array([xxhash.xxh64_intdigest(host) for host, _ in pages], np.uint64), sizes)
    text, at, out = " ".join([line for line in lines if line]).encode(), 0, [np.zeros(0, np.uint64)]
    while at < len(text):
        stop = text.find(b" ", at + PART)
        stop = len(text) if stop < 0 else stop
        out.append(_word_hashes(text[at:stop]))
        at = stop + 1
    return (_mixed(np.concatenate(out) ^ sites) >> np.uint64(32)).astype("<u4"), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def hashes(codes: np.ndarray) -> np.ndarray:
    """36 bits of a hash of the RUN codes from each place on; none where fewer go on."""
    n = max(len(codes) - RUN + 1, 0)
    h = np.zeros(n, np.uint64)
    for j in range(RUN):
        h = (h ^ codes[j:n + j]) * np.uint64(0x9E3779B185EBCA87)
        h ^= h >> np.uint64(29)
    return h >> np.uint64(28)


def _distinct_streams(batches):
    """(ids, codes, bounds, hashes, page) of some of the task's pages (url, html), each text once; hashes of their suffixes, and which page each is of (-1 where
    fewer than RUN of its words go on)."""
    def group():
        codes, bounds = streams([p[1:] for p in held])
        h = hashes(codes)
        page = np.full(len(codes), -1)
        for k, (first, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            page[first:max(first, end - RUN + 1)] = k
        return [p[0] for p in held], codes, bounds, h, page[:len(h)]

    seen, held, size = set(), [], 0
    for b in batches:
        for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            host, cut = host_of(url), blocks(page or "")
            sid = stream_id(host, cut)
            if sid not in seen:
                seen.add(sid)
                held.append((sid, host, cut))
                size += len(page or "") + 16
                if size >= GROUP:
                    yield group()
                    held, size = [], 0
    if held:
        yield group()


def _bucketed(held: list[np.ndarray]):
    """One row a bucket: the last three bytes of its hashes, at most two of a kind."""
    h = np.sort(np.concatenate(held))
    h = h[np.concatenate([[True, True], h[2:] != h[:-2]])[:len(h)]]
    cuts = np.searchsorted(h, np.arange(1, BUCKETS, dtype=np.uint64) << np.uint64(24))
    parts = np.split(h.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3], cuts)
    rows = [(k, part.tobytes()) for k, part in enumerate(parts) if len(part)]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "low"])


def _page_hashes(batches):
    """Hashes of all suffixes of the pages (url, html), a page's repeats once."""
    held, n = [], 0
    for *_, h, page in _distinct_streams(batches):
        own = np.sort(page[page >= 0].astype(np.uint64) << np.uint64(36) | h[page >= 0])        # no 2 ** 28 pages in a group
        if not len(own):
            continue
        own = own[np.concatenate([[True], own[1:] != own[:-1]])] & np.uint64((1 << 36) - 1)
        held.append(own)
        n += len(own)
        if n >= FLUSH:
            yield from _bucketed(held)
            held, n = [], 0
    if n:
        yield from _bucketed(held)


def _marked(batches):
    """Rows in the order of buckets: each bucket's part of the bitmap, with a mark for hashes that come twice."""
    def marks(bucket, held):
        low = np.zeros((sum(map(len, held)) // 3, 4), np.uint8)
        low[:, :3] = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 3)
        h = np.sort(low.view("<u4").ravel())
        bits = np.zeros(MARKS, bool)
        bits[h[1:][h[1:] == h[:-1]] >> 8] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bucket", "bits"])

    now, held = None, []
    for b in batches:
        for bucket, low in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if bucket != now and held:
                yield from marks(now, held)
                held = []
            now = bucket
            held.append(low)
    if held:
        yield from marks(now, held)


class Bits:
    """The bitmap. Few marks are set where little is repeated, so it travels compressed."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks

    def __reduce__(self):
        return _unpacked, (zlib.compress(self.marks, 1),)


def _unpacked(packed: bytes) -> Bits:
    return Bits(np.frombuffer(zlib.decompress(packed, bufsize=BUCKETS * MARKS // 8), np.uint8))


def marked_bits(pages: DataFrame) -> Bits:
    """The bitmap of suffixes' hashes that come twice, 32 MB whatever the number of pages."""
    found = pages.mapInArrow(_page_hashes, "bucket int, low binary")
    # stored, so that the hashes leave the disk before suffixes are dealt
    rows = stored(found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_marked, "bucket int, bits binary"), "marks")
    bits = np.zeros((BUCKETS, MARKS // 8), np.uint8)
    for r in rows.toLocalIterator():
        bits[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return Bits(bits.ravel())


def _stretch_words(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending places from which RUN words are needed: all those words' places, each once, and where each place is among them."""
    gaps = np.diff(at, prepend=at[0])
    where = np.cumsum(np.minimum(gaps, RUN))
    words = np.empty(where[-1] + RUN, np.int64)
    for j in range(RUN):
        words[where + j] = at + j
    return words, where


def _stretches(bits):
    """The marked places of each stream from which at least RUN words go on, as bits, and the codes of the words from there."""
    def of(batches):
        marks, rows, size = bits.value.marks, [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["sid", "places", "codes"])

        for ids, codes, bounds, h, page in _distinct_streams(batches):
            h >>= np.uint64(8)
            there = (marks[h >> np.uint64(3)] >> (7 - (h & np.uint64(7)).astype(np.uint8)) & 1) * (page >= 0)
            for sid, first, end in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist()):
                own = there[first:end]
                if own.any():
                    words, _ = _stretch_words(np.flatnonzero(own))
                    rows.append((sid, np.packbits(own).tobytes(), codes[first:end][words].tobytes()))
                    size += end - first
                    if size >= FLUSH >> 3:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()
    return of


def _suffixes(batches):
    """Every marked place as (suffix, sid, at)."""
    def batch(held):
        keys, sids, places = (np.concatenate(x) for x in zip(*held))
        flat = pa.Array.from_buffers(pa.binary(KEY), len(places), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([flat, pa.array(sids), pa.array(places.astype(np.int32))], names=["suffix", "sid", "at"])

    held, n = [], 0
    for b in batches:
        for sid, places, codes in zip(*(c.to_pylist() for c in b.columns)):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(places, np.uint8)))
            codes, (_, where) = np.frombuffer(codes, "<u4"), _stretch_words(at)
            for k in range(0, len(at), PLACES):
                part = at[k:k + PLACES]
                held.append((codes[where[k:k + PLACES, None] + np.arange(RUN)], np.full(len(part), sid), part))
                n += len(part)
                if n >= PLACES:
                    yield batch(held)
                    held, n = [], 0
    if held:
        yield batch(held)


def _runs(batches):
    """Sorted suffixes: (sid, at) of those in a run of neighbours that share their leading words and come from distinct pages. The first and the last run of a
    batch may go on in another: they give a row (suffix, lo, hi) too, and places with their suffix where one page is known of so far."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        flat, sid, at = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
        keys = np.frombuffer(flat.buffers()[2], np.uint8)[flat.offset * KEY:(flat.offset + n) * KEY].reshape(n, KEY)
        starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
        ends = np.append(starts[1:], n)
        several = sid[starts] != sid[ends - 1]
        sure = np.repeat(several, ends - starts)
        rows = []
        for k in sorted({0, len(starts) - 1}):
            key = keys[starts[k]].tobytes()
            rows.append((None, None, key, int(sid[starts[k]]), int(sid[ends[k] - 1])))
            if not several[k]:
                rows += [(s, a, key, None, None) for s, a in zip(sid[starts[k]:ends[k]].tolist(), at[starts[k]:ends[k]].tolist())]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        known = [pa.array(sid[sure]), pa.array(at[sure]), *(pa.nulls(int(sure.sum()), t) for t in kinds[2:])]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([k, pa.array(c, t)]) for k, c, t in zip(known, zip(*rows), kinds)], names=["sid", "at", "suffix", "lo", "hi"])


def _covers(batches):
    """(sid, cover): the stretches of words, as (first, last + 1), that repeated substrings beginning at ``at`` cover."""
    for b in batches:
        covers = []
        for places in b.column(1).to_pylist():
            at = np.unique(np.array(places, np.int64))
            parts = np.flatnonzero(at[1:] > at[:-1] + RUN) + 1
            firsts, lasts = at[np.concatenate([[0], parts])], at[np.append(parts - 1, len(at) - 1)] + RUN
            covers.append([{"first": f, "end": e} for f, e in zip(firsts.tolist(), lasts.tolist())])
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(covers, kind)], names=["sid", "cover"])


def _page_texts(batches):
    """Blocks but for named surroundings, as lines of one compressed text, and the places in the stream of those that are not the article's."""
    for b in batches:
        rows = []
        for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            cut = blocks(page or "")
            lines, undecided, first = [], [], 0
            for text, kind in cut:
                n = text.count(" ") + 1
                if kind == OPEN:
                    undecided.append({"line": len(lines), "first": first, "n": n})
                if kind != SURROUNDINGS:
                    lines.append(text)              # white space is single spaces: no line feed in a block
                first += n
            rows.append((stream_id(host_of(url), cut), zlib.compress("\n".join(lines).encode(), 1), undecided))
        if rows:
            places = pa.list_(pa.struct([("line", pa.int32()), ("first", pa.int32()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(2, b.num_columns)), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), places)))],
                                             names=[*b.schema.names[2:], "sid", "lines", "undecided"])


def _mostly_covered(undecided: list[dict], cover: list[dict]) -> set[int]:
    """Lines of which more than half of the words are covered."""
    line, first, n = (np.array([u[k] for u in undecided], np.int64) for k in ("line", "first", "n"))
    starts, ends = (np.array([c[k] for c in cover], np.int64) for k in ("first", "end"))    # apart and ascending
    before = np.concatenate([[0], np.cumsum(ends - starts)])

    def covered(at):
        k = np.searchsorted(starts, at, "right")
        return before[k] - np.where(k > 0, np.maximum(ends[np.maximum(k, 1) - 1] - at, 0), 0)

    return set(line[2 * (covered(first + n) - covered(first)) > n].tolist())


def _left(batches):
    """Columns kept, ``text`` and ``covered``. Unique runs stay; so does the article, covered or not."""
    for b in batches:
        keep, begin, texts, covered, size = b.num_columns - 3, 0, [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([*(b.column(i).slice(begin, len(texts)) for i in range(keep)), pa.array(texts, pa.string()), pa.array(covered, pa.int64())],
                                              names=[*b.schema.names[:keep], "text", "covered"])

        for packed, undecided, cover in zip(*(b.column(keep + i).to_pylist() for i in range(3))):
            text = zlib.decompress(packed).decode()
            if undecided and cover:
                gone = _mostly_covered(undecided, cover)
                text = "\n".join([t for i, t in enumerate(text.split("\n")) if i not in gone])
            texts.append(text)
            covered.append(sum([c["end"] - c["first"] for c in cover or []]))
            size += len(text)
            if size >= CHARS:
                yield batch()
                begin, texts, covered, size = begin + len(texts), [], [], 0
        if texts:
            yield batch()


def repeats(pages: DataFrame) -> DataFrame:
    """The stretches of each stream that substrings repeated on other pages of the host cover: (sid, cover). ``pages``: url, html."""
    bits = pages.sparkSession.sparkContext.broadcast(marked_bits(pages))
    # stored, as the ranges of the array are counted before its suffixes are dealt
    stretches = stored(pages.mapInArrow(_stretches(bits), "sid long, places binary, codes binary"), "stretches")
    bits.destroy()
    rows = stretches.mapInArrow(_suffixes, "suffix binary, sid long, at int")
    order = rows.repartitionByRange("suffix", "sid").sortWithinPartitions("suffix", "sid")
    found = stored(order.mapInArrow(_runs, "sid long, at int, suffix binary, lo long, hi long"), "repeats")
    several = found.where("lo is not null").groupBy("suffix").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("suffix")
    more = found.where("sid is not null and suffix is not null").join(several, "suffix")
    places = found.where("sid is not null and suffix is null").select("sid", "at").unionByName(more.select("sid", "at"))
    return places.groupBy("sid").agg(F.collect_set("at").alias("at")).mapInArrow(_covers, "sid long, cover array<struct<first:int,end:int>>")    # at most the words of one page


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``pages`` (url, html) plus ``text``, the main text, ``n_chars`` and ``covered``, the page's words
    that substrings repeated on other pages of the host cover."""
    held = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    source = pages.select(F.col("url").cast("string").alias("__url"), F.col("html").cast("string").alias("__html"), *held)
    covers = stored(repeats(source.select("__url", "__html")), "covers")
    fields = [T.StructField(f"k{i}", pages.schema[c].dataType) for i, c in enumerate(keep)]
    places = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("n", T.IntegerType())]))
    cut = source.mapInArrow(_page_texts, T.StructType(fields + [T.StructField("sid", T.LongType()), T.StructField("lines", T.BinaryType()), T.StructField("undecided", places)]))
    both = cut.join(covers, "sid", "left").select(*[f.name for f in fields], "lines", "undecided", "cover")
    out = both.mapInArrow(_left, T.StructType(fields + [T.StructField("text", T.StringType()), T.StructField("covered", T.LongType())]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "covered").withColumn("n_chars", F.length("text").cast("long"))
