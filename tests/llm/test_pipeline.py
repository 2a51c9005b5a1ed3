"""The pipeline's stages against brute force, each on its own input."""
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from telemetra.llm import quality, queries
from telemetra.llm.tables import stored, tuned

from test_small_fixtures import DE, EN, brute_components, corpus, prose, simhash_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def raw(spark):
    rng = random.Random(21)
    rows = corpus() + [(200 + i, prose(rng, EN if i % 2 else DE, 80), "en" if i % 2 else "de") for i in range(40)]
    rows += [(300, rows[3][1] + "\n", "en"), (301, rows[3][1].replace(" ", "\n"), "en"), (302, " ".join(w + "***" for w in rows[4][1].split()), "de")]
    return spark.createDataFrame([(i, t, l, "s", len(t or "")) for i, t, l in rows], SCHEMA).withColumn("score", F.lit("clash"))


def nearest_kept(texts):
    """The smallest id of every component of the texts whose fingerprints differ in four bits at most, over all pairs."""
    ids = sorted(texts)
    first = {}
    for i, root in zip(ids, brute_components([simhash_of(texts[i]) for i in ids])):
        first.setdefault(root, i)
    return set(first.values())


def test_run_against_plain_python(spark, tmp_path):
    """All stages in one run over documents.parquet; the rules' verdicts are the operator's, everything else is plain Python."""
    from tokenizers import Tokenizer
    tuned(spark)
    rows = [tuple(r) for r in raw(spark).drop("score").where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = P.run(spark, str(tmp_path)).collect()

    left = [r for r in rows if r[1] is not None and any(map(str.isalpha, r[1]))]
    measured = quality.measure(spark.createDataFrame(left, SCHEMA), ["doc_id"])
    good = {r[0] for r in quality.judge(measured, quality.fit(measured)).where("kept").select("__row.doc_id").collect()}
    groups = defaultdict(list)
    for r in left:
        if r[0] in good:
            groups[re.sub("[\x20\x09-\x0d]", "", r[1])].append(r)
    apart = [min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values()]
    texts = {r[0]: r[1] for r in apart}
    kept = nearest_kept(texts)
    assert len(good) < len(left) and len(kept) < len(good)

    lib = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    by, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(by) == kept
    for i, own in by.items():
        ids = np.array(lib.encode(texts[i], add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024


def test_every_stage(spark):
    docs = stored(raw(spark), "raw")
    columns = docs.columns
    seen = []
    for k, (name, f) in enumerate(P.STAGES):
        before = docs.collect()
        out = stored(f(spark, docs, ""), "stage")
        after = out.collect()
        seen.append((name, len(before), len(after)))
        if k < 4:
            assert out.columns == columns and set(after) <= set(before)
        if name == "language":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {100, 101, 102, 103}
        elif name == "quality":
            assert all(len(re.findall("[^\x20\x09-\x0d]+", r.text)) >= 50 for r in after)
            assert {r.doc_id for r in after} >= set(range(60))
        elif name == "exact copies":
            groups = defaultdict(list)
            for r in before:
                groups[re.sub("[\x20\x09-\x0d]", "", r.text)].append(r)
            want = sorted(min(g, key=lambda r: (-len(r.text), r.doc_id)).doc_id for g in groups.values())
            assert sorted(r.doc_id for r in after) == want
        elif name == "near copies":
            assert sorted(r.doc_id for r in after) == sorted(nearest_kept({r.doc_id: r.text for r in before}))
        else:
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
        docs = out
    assert [n for n, _, _ in seen] == ["language", "quality", "exact copies", "near copies", "packing"]


def test_stages_on_an_empty_table(spark):
    docs = raw(spark).where("false")
    for name, f in P.STAGES[:4]:
        assert f(spark, docs, "").count() == 0, name


@pytest.mark.parametrize("column", ["lang", "doc_id"])
def test_language_stage_without_usable_labels(spark, column):
    docs = raw(spark).withColumn(column, F.lit(None).cast("string" if column == "lang" else "long"))
    out = P.identify_language(spark, docs, "")
    want = sorted(r.text for r in docs.collect() if r.text is not None and any(map(str.isalpha, r.text)))
    assert out.columns == docs.columns and sorted(r.text for r in out.collect()) == want and len(want) > 100
