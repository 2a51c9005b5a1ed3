"""Merkle manifest, conversation trie and main texts against brute force, on odd rows and on whole tables."""
import glob
import hashlib
import html
import math
import os
import pickle
import random
import re
import tempfile
import time
import uuid
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from telemetra.llm import html_text, merkle, queries, ranks, trie
from telemetra.llm.tables import table, tuned

SF = "/root/testdata/sf0.001"
CLASH = ["tree", "place", "size", "digest", "member", "depth", "part", "sid", "keep", "k0", "texts", "changed", "conv", "entry", "__g", "__at"]


def clashing(df):
    return df.select("*", *[F.lit("other").alias(c) for c in CLASH if c not in df.columns])


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    tuned(spark)


# --- places --------------------------------------------------------------------------------------------------------------

def test_places_in_groups_of_any_size(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), rng.randrange(40), i) for i in range(3000)] + [("c", None, -1)]
    got = ranks.ranked(spark.createDataFrame(rows, "g string, v int, id int").repartition(5), "g", [F.col("v").asc_nulls_first(), F.col("id").asc()], "t").collect()
    groups = defaultdict(list)
    for g, v, i in rows:
        groups[g].append((v is not None, v, i))
    want = {(g, i): (k, len(rs)) for g, rs in groups.items() for k, (_, _, i) in enumerate(sorted(rs, key=lambda r: (r[0], r[1] or 0, r[2])))}
    assert {(r.g, r.id): (r.place, r.size) for r in got} == want and len(got) == len(rows)


# --- op11 ----------------------------------------------------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, low=False):
    text = row[4] if row[4] is None or not low else re.sub("[A-Z]", lambda m: m[0].lower(), row[4])
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_siblings(levels, i):
    out = []
    for level in levels[:-1]:
        lo = i // 16 * 16
        out.append((level[lo:i], level[i + 1:lo + 16]))
        i //= 16
    return out


def plain_manifest(rows):
    """Tuples (doc_id, leaf, subroot, root, proof, folded, verified)."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    trees = {}
    for s, rs in by.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = plain_levels([leaf_of(r) for r in rs])
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = plain_levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = plain_siblings(trees[s], i) + plain_siblings(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            d = leaf_of(r, hit)
            for a, b in path:
                d = sha("".join([*a, d, *b]))
            out.append((r[0], leaf_of(r), trees[s][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in path)), d, d == top[-1][0]))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def manifest(df):
    return merkle.build(merkle.leaves(df, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0))


def docs_rows():
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.7 else f"s{rng.randrange(30)}", "en", i, "Some Text %d" % (i % 7)) for i in range(9000)]
    rows += [(9001, "lone", None, None, None), (9002, None, "de", 5, ""), (None, None, None, None, None), (None, "ß", "en", 1, "A"), (9003, "Z", "x", 2, "É Ä" * 20_000),
             (5, "hot", "en", 5, "Some Text 5"), (7, "", "en", -1, "lower only")]
    return rows + [rows[9], rows[9]]


def test_manifest_equals_brute_force(spark):
    rows = docs_rows()
    m = manifest(clashing(spark.createDataFrame(rows, DOCS)).repartition(7))
    got = [tuple(r) for r in merkle.proofs(m).collect()]
    want = plain_manifest(rows)
    assert len(m.tiers) == 2                                       # the large source is more than a block
    key = lambda t: tuple((x is not None, x or 0) for x in t)     # noqa: E731
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[0] for r in got if not r[6]} == {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] and r[4] != re.sub("[A-Z]", lambda c: c[0].lower(), r[4])}


def test_versions_copy_ancestors_and_share_the_rest(spark):
    rows = docs_rows()
    m = manifest(spark.createDataFrame(rows, DOCS))
    base = {(r.tree, r.level, r.index): r.digest for r in merkle.nodes(m).collect()}
    assert base[max((k for k in base if k[0] == merkle.TOP), key=lambda k: k[1])] == m.root
    folded = {(r.doc_id, r.leaf): r.folded_root for r in merkle.proofs(m).collect()}
    copies = defaultdict(dict)
    for r in merkle.versions(m).collect():
        copies[r.doc_id, r.source_tree][r.step] = r.digest
    hits = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {k[0] for k in copies} == {r[0] for r in hits}
    sizes = Counter(r[1] for r in rows)
    height = lambda n: len(plain_levels(["x"] * n)) - 1             # noqa: E731
    for r in hits[:200]:
        version = copies[r[0], "1" + r[1]]
        assert len(version) == 1 + height(sizes[r[1]]) + height(len(sizes)) and version[0] == leaf_of(r, True)
        assert version[max(version)] == folded[r[0], leaf_of(r)]


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 256, 257, 4096, 4097])
def test_trees_of_every_form(spark, n):
    rows = [(i, "only", "en", i, f"T{i}") for i in range(n)]
    m = manifest(spark.createDataFrame(rows, DOCS))
    got = merkle.proofs(m)
    if n == 0:
        assert m.root is None and got.count() == 0
    else:
        assert sorted(tuple(r) for r in got.collect()) == sorted(plain_manifest(rows))


# --- op12 ----------------------------------------------------------------------------------------------------------------

def plain_trie(rows, group=5, shared=9):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in convs.items()}
    seqs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        seqs[c] = tuple(own.get(c - int(math.fmod(c, group)), [])[:h] + ts[h:])
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[:d - 1]].add(s[:d])
        ends[s].append(c)
    leaves, saved = Counter(), Counter()
    for node, cs in members.items():
        worth = (len(cs) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += worth
            leaves[node[:d]] += node not in kids
    return [(min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), len(kids[n]) if n in kids else 0, leaves[n], saved[n],
             sha(",".join(map(str, sorted(ends.get(n, [])))))) for n, cs in members.items()]


CONVS = "conv_id long, turn long, role string, text string"


def conversations():
    rng = random.Random(8)
    rows = []
    for c in range(300):
        first = "Hello" if c % 3 else rng.choice(["Hi", "Hey"])
        for t in range(rng.randrange(1, 14)):
            rows.append((c * 2, t, "user" if t % 2 == 0 else "assistant", first if t == 0 else rng.choice(["yes", "no", "größer", ""])))
    for c in range(1000, 1400):                                     # copies, a common first turn, and one that the others go on from
        rows += [(c, t, "user", x) for t, x in enumerate(["Hello", "same", "again"][:3 if c % 40 else 2])]
    rows += [(2000, t, "user", f"long {t % 50}") for t in range(150)] + [(2005, t, "user", f"long {t % 50}") for t in range(149)]
    rows += [(2010, None, None, None), (2010, None, "user", "x"), (2010, 3, "user", None), (2010, 3, "user", None), (2011, 1, None, "only"), (None, 1, "user", "nobody"),
             (-7, 0, "user", "Hello"), (-5, 0, "system", "a\x1fb"), (2023, 0, "us", "era"), (2020, 0, "user", "a")]
    return rows


@pytest.mark.parametrize("chunk,stretch", [(4096, 4096), (50, 7)])
def test_trie_equals_brute_force(spark, monkeypatch, chunk, stretch):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "STRETCH", stretch)
    rows = conversations()
    df = clashing(spark.createDataFrame(rows, CONVS)).repartition(5)
    assert Counter(tuple(r) for r in trie.conversation_trie(df).collect()) == Counter(plain_trie(rows))


def test_trie_of_an_empty_table_and_of_a_lone_conversation(spark):
    assert trie.conversation_trie(spark.createDataFrame([], CONVS)).count() == 0
    rows = [(4, 0, "user", "a")]                                   # nothing of its own left, and no conversation to go on from
    assert [tuple(r) for r in trie.conversation_trie(spark.createDataFrame(rows, CONVS)).collect()] == plain_trie(rows)


# --- op13 ----------------------------------------------------------------------------------------------------------------

class Plain(HTMLParser):
    """Blocks of the article, read by the standard library's parser; for pages whose article holds headings, paragraphs and inline markup only."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.now, self.out = False, "", []

    def flush(self):
        if self.now.split() and self.inside:
            self.out.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "a", "i", "br"):
            self.flush()
        self.inside = self.inside or tag == "article"

    def handle_endtag(self, tag):
        if tag not in ("b", "a", "i"):
            self.flush()
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        self.now += data


def plain_text(page):
    p = Plain()
    p.feed(page or "")
    p.close()
    p.flush()
    return "\n".join(p.out)


def test_main_texts_of_the_whole_table(spark):
    pages = table(spark, SF, "pages").union(table(spark, "/root/testdata/sf0.01", "pages")).collect()
    got = html_text.extract(clashing(spark.createDataFrame(pages, "page_id long, url string, html string")), ["page_id", "url"]).collect()
    want = Counter((p.page_id, p.url, plain_text(p.html)) for p in pages)
    assert Counter((r.page_id, r.url, r.text) for r in got) == want and all(r.n_chars == len(r.text) for r in got)
    # menus, adverts and footers that a host repeats are found as such
    assert sum(r.covered for r in got) > 4 * len(got)


def page(i, menu, body, foot="Imprint and contact of the example house in Berlin"):
    return f"<html><body><div>{menu}</div><div><h2>Story {i}</h2>{body}</div><div>{foot}</div></body></html>"


def test_a_host_without_named_parts_is_cleaned_by_its_repeats(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    menu = "<ul><li>Home<li>News<li>Sports<li>Culture<li>Travel<li>Weather today</ul>"
    bodies = ["".join(f"<p>{' '.join(word() for _ in range(30))}</p>" for _ in range(3)) for _ in range(40)]
    rows = [(i, "http://a.example/%d" % i, page(i, menu, b)) for i, b in enumerate(bodies)]
    rows += [(100 + i, "http://b.example/%d" % i, page(i, menu, bodies[0])) for i in range(30)]     # each other's copies but for the heading
    rows += [(200 + i, "http://c.example/", page(0, menu, bodies[1])) for i in range(30)]           # one page, many times
    rows += [(300, "http://d.example/", page(0, menu, bodies[2]))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    text = lambda b: "\n".join(re.findall("<p>(.*?)</p>", b))           # noqa: E731
    for i in range(40):
        assert got[i] == f"Story {i}\n{text(bodies[i])}"
    whole = lambda k: "\n".join(["Home", "News", "Sports", "Culture", "Travel", "Weather today", "Story 0", text(bodies[k]), "Imprint and contact of the example house in Berlin"])
    assert all(got[200 + i] == whole(1) for i in range(30)) and got[300] == whole(2)   # nothing says what repeats
    assert all(got[100 + i] == f"Story {i}" for i in range(30))                        # told in the docstring


def plain_cover(streams):
    """Words of each stream (list of stretches) that are part of RUN words found on another page of the host; streams: {page: (host, stretches)}."""
    seen = defaultdict(set)
    for p, (host, parts) in streams.items():
        for part in parts:
            for i in range(len(part) - html_text.RUN + 1):
                seen[host, tuple(part[i:i + html_text.RUN])].add(p)
    out = {}
    for p, (host, parts) in streams.items():
        n = 0
        for part in parts:
            hit = set()
            for i in range(len(part) - html_text.RUN + 1):
                if len(seen[host, tuple(part[i:i + html_text.RUN])]) > 1:
                    hit.update(range(i, i + html_text.RUN))
            n += len(hit)
        out[p] = n
    return out


def test_covered_words_equal_brute_force(spark):
    rng = random.Random(6)
    streams, rows = {}, []
    for i in range(120):
        host = "h%d.example" % (i % 3 if i % 2 else 0)
        parts = [[rng.choice("abcd") for _ in range(rng.randrange(0, 14))] for _ in range(3)]
        streams[i] = (host, parts)
        text = "<article>n%d</article>" % i
        rows.append((i, f"https://{host}/x", text.join("<p>" + " ".join(p) + "</p>" for p in parts)))
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6), ["page_id"]).collect()
    # an empty stretch between two articles does not part streams that are parted already
    assert {r.page_id: r.covered for r in got} == plain_cover(streams)


def test_articles_are_part_of_the_streams(spark):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    quote, menu = words("q", 7), words("m", 4)
    # menu and advert are too short to repeat by themselves, but go on into the article
    rows = [(i, "http://a.example/%d" % i, f"<div>{menu}</div><article><p>{quote}</p><p>{words(i, 9)}</p></article>") for i in range(5)]
    rows += [(9, "http://b.example/", rows[0][2]), (10, "http://a.example/copy", rows[0][2]), (11, "http://a.example/0", rows[0][2])]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), ["page_id"]).collect()}
    for i in (0, 1, 2, 3, 4, 10, 11):
        assert (got[i].covered, got[i].text) == (11, f"{quote}\n{words(0 if i > 4 else i, 9)}")
    assert (got[9].covered, got[9].text) == (0, f"{menu}\n{quote}\n{words(0, 9)}")


def test_codes_of_words():
    words = ["a", "aa", "b", "ab", "ba", "é", "x" * 300, "x" * 301, "x" * 70_000, *("w%d" % i for i in range(40_000))]
    whole = [(" ".join(words[:4]), 0), (" ".join(words[4:]), 1)]
    codes, bounds = html_text.streams([("h", whole)])
    assert len(codes) == len(words) and len(np.unique(codes)) >= len(words) - 3 and bounds.tolist() == [0, len(words)]
    n = len(words)
    more, bounds = html_text.streams([("h", []), ("h", [(" ".join(reversed(words)), 2)]), ("g", whole), ("h", []), ("h", [("ab", 0)])])
    assert bounds.tolist() == [0, 0, n, 2 * n, 2 * n, 2 * n + 1]
    assert (more[:n][::-1] == codes).all() and (more[n:2 * n] != codes).mean() > 0.99 and more[-1] == codes[3]
    assert len(html_text.streams([("h", [])])[0]) == 0


def test_pages_are_cut_no_more_than_three_times(spark, tmp_path):
    def counted(batches):
        for b in batches:
            (tmp_path / uuid.uuid4().hex).write_text(str(b.num_rows))
            yield b

    rows = [(i, "http://a.example/", f"<p>{' '.join('w%d' % (i % 7 + k) for k in range(30))}</p>") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = html_text.extract(df.mapInArrow(counted, df.schema), ["page_id"]).collect()
    assert len(got) == 40 and sum(int(p.read_text()) for p in tmp_path.iterdir()) <= 3 * 40


@pytest.mark.parametrize("at", [[0], [5], [0, 1, 2], [3, 8, 9, 15, 16, 40], [0, 6, 12], [2, 9, 30]])
def test_words_of_stretches(at):
    at, codes = np.array(at), np.arange(100, 200)
    words, where = html_text._stretch_words(at)
    assert len(set(words.tolist())) == len(words)
    assert (codes[words][where[:, None] + np.arange(html_text.RUN)] == codes[at[:, None] + np.arange(html_text.RUN)]).all()


def test_what_travels_is_small():
    # a bitmap with few marks, sent to every executor
    marks = np.zeros(html_text.BUCKETS * html_text.MARKS // 8, np.uint8)
    marks[::100_000] = 3
    sent = pickle.dumps(html_text.Bits(marks))
    assert len(sent) < 1 << 20 and (pickle.loads(sent).marks == marks).all()
    # what a page's text is joined with its covers by
    line = "Some words of a story that goes on with the same few words of a story "
    page = "<nav>menu</nav>" + f"<article><p>{line * 20}</p></article>" + "<div>more of it</div>" * 3
    rows = pa.RecordBatch.from_pydict({"url": ["http://a.example/"] * 50, "html": [page] * 50, "k0": list(range(50))})
    out = list(html_text._page_texts([rows]))
    assert sum(b.nbytes for b in out) < rows.nbytes / 4


def shuffled():
    return set(glob.glob(os.path.join(os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir(), "blockmgr-*", "*", "shuffle_*.data")))


def test_hashes_and_suffixes_leave_the_disk(spark, tmp_path):
    rows = [(i, "http://a.example/", f"<p>{' '.join('w%d' % (i % 7 + k) for k in range(30))}</p>") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4, "page_id").localCheckpoint()
    before = shuffled()
    df.groupBy("url").count().repartition(3).write.parquet(str(tmp_path / "kept"))
    assert shuffled() - before                          # a plain write leaves its shuffles' files
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled(), spark.conf.get(name, None)
    out = html_text.extract(df, ["page_id"])            # all but the last join has run
    end = time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(name, None) == setting
    assert [out.count(), out.where("covered > 0").count()] == [40, 40]


def test_texts_in_several_batches(monkeypatch):
    monkeypatch.setattr(html_text, "CHARS", 30)
    pages = [f"<div>one two three</div><article>story {i}</article><div>four five six seven</div><div>eight</div>" for i in range(20)]
    cut = next(html_text._page_texts([pa.RecordBatch.from_pydict({"url": [None] * 20, "html": pages, "k0": list(range(20))})]))
    covers = [None, [], [{"first": 1, "end": 3}], [{"first": 0, "end": 1}, {"first": 2, "end": 3}, {"first": 5, "end": 7}], [{"first": 4, "end": 9}, {"first": 9, "end": 10}]] * 4
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    both = pa.RecordBatch.from_arrays([cut["k0"], cut["lines"], cut["undecided"], pa.array(covers, kind)], names=["k0", "lines", "undecided", "cover"])
    got = [r for b in html_text._left([both]) for r in b.to_pylist()]
    a, f, e = "one two three", "four five six seven", "eight"
    left = [(a, f, e), (a, f, e), (f, e), (f, e), (a,)]             # half of the words covered: it stays
    want = [(i, "\n".join([*left[i % 5][:left[i % 5].count(a)], f"story {i}", *left[i % 5][left[i % 5].count(a):]]), [0, 0, 2, 4, 6][i % 5]) for i in range(20)]
    assert [(r["k0"], r["text"], r["covered"]) for r in got] == want


CASES = [
    (None, ""), ("", ""), ("  \n ", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\nb"), ("a &lt;b&gt; &#x41;&nbsp;&eacute; &nosuch; &am", "a <b> A é &nosuch; &am"),
    ("<article><p>wor<b>d</b> one<br>two\n\tthree</p></article>", "word one two three"), ("<nav>menu</nav><article>t</article><footer>f</footer>", "t"),
    ("<article><h1>T</h1><nav>n</nav><p>x<span class='ad-box'>buy</span>y</p><aside>s</aside><form>f<input></form><section id=comments><article>c</article></section></article>", "T\nx\ny"),
    ("<article><header><h1>T</h1></header><p>b</p><footer>by</footer></article>", "T\nb"), ("<header>top</header><main><p>b</p></main><div class='cookieNotice'>c</div>", "b"),
    ("<div class='page has-sidebar'><p>b</p></div><div role=navigation>n</div><div class=sidebar>s</div>", "b"), ("<script>var a='</p>';</script><style>p{}</style><!-- x <p>y --><p>z", "z"),
    ("<p>a<!-- open <p>b", "a"), ("<script>never closed <p>b", ""), ("<p title='a>b'>c</p><a href=x", "c"), ("1 < 2 and 3 > 2 <3", "1 < 2 and 3 > 2 <3"), ("<title>t</title><body>b", "b"),
    ("<head><meta charset=x>lost<body><p>b", "b"), ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"), ("<article><ul><li>a<ul><li>b</ul><li>c</ul></article>", "a\nb\nc"),
    ("<main>lead<article>body</article></main>", "lead\nbody"), ("<article>a</article><p>after</p>", "a\nafter"), ("<article><p>x</b></i></div>y</p></article>", "x\ny"),
    ("<ARTICLE><P CLASS=\"AD\">q</P><P>w</ARTICLE>", "w"), (" a b ", "a b"), ("<article><h2 class=header>H</h2><div class='ads'><div>x</div></div>y</article>", "H\ny"), ("x" * 50_000 + "<p>" + "y " * 60_000, "x" * 50_000 + "\n" + ("y " * 60_000).strip()),
    ("<b>" * 3000 + "deep" + "</b>" * 3000, "deep"), ("<div>" * 3000 + "deep", "deep"), ("<svg/><p>a</p><svg><text>s</text></svg>", "a"), ("<article><textarea>t</textarea><noscript>n</noscript>k</article>", "k")]


def test_odd_pages(spark):
    rows = [(i, None if i % 2 else f"http://h{i}.example/", c[0]) for i, c in enumerate(CASES)]
    got = {r.page_id: r.text for r in html_text.extract(clashing(spark.createDataFrame(rows, "page_id long, url string, html string")), ["page_id"]).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[1] for c in CASES]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string"), ["page_id"]).count() == 0


def test_hosts():
    for url, host in [("http://User:p@Ex.com:80/a", "ex.com"), ("https://a.b?x", "a.b"), (None, ""), ("no url", ""), ("/path", "")]:
        assert html_text.host_of(url) == host
