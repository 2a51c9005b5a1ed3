"""Manifest of a dataset as a Merkle tree, kept as a persistent tree with path copying.

Rows are leaves. Within a source they ascend by id, and every 16 neighbours have one parent until a single node, the subroot, is left;
the subroots, ordered by source, have a tree of the same form above them. A changed row is a version of the tree: it copies the leaf's
ancestors and nothing else, every other node is shared with the base.

Three levels at a time are worked on where they lie: an aligned block of 4096 nodes is one row, whose inner nodes, copies and sibling
lists never leave the task. The blocks' roots are the nodes of the next tier. On the way down a block receives the siblings above it, so a
version that leaves its block goes on from there: no task sees more than a block, and a source of any size is many blocks.

Defined results: a null field is hashed as ``-``, an empty text as ``0:``. Rows that share an id (or have none; these come first) are
ordered by their leaf. Rows equal in all fields are leaves of their own. An empty table has no leaves and no root. Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .ranks import ranked
from .tables import stored

FANOUT = 16
LEVELS = 3                              # levels of a block
BLOCK = FANOUT ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TOP = "top"                             # name of the tree of subroots; those of sources begin with a digit

#: What stands before and after a node among its siblings, level by level upwards, as hex text.
PATH = T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """Hex SHA-256 of the fields: ``-`` for null, else byte count, colon, value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts]), 256)


def climb(nodes: list[str], levels: int | None) -> list[list[str]]:
    """All levels over ``nodes``: ``levels`` of them, or until one node is left."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([_hash("".join(below[i:i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return out


def steps(levels: list[list[str]], at: int) -> list[dict]:
    """The siblings of leaf ``at`` on each level: what stands before and after its ancestor in the run."""
    out = []
    for level in levels[:-1]:
        run = level[at // FANOUT * FANOUT:at // FANOUT * FANOUT + FANOUT]
        out.append({"before": "".join(run[:at % FANOUT]), "after": "".join(run[at % FANOUT + 1:])})
        at //= FANOUT
    return out


def fold(digest: str, path: list[dict]) -> list[str]:
    """The copied ancestors of a leaf, lowest first; the last one is the version's root."""
    out = []
    for step in path:
        digest = _hash(step["before"] + digest + step["after"])
        out.append(digest)
    return out


@dataclass
class Manifest:
    """``tiers[k]``: stored blocks of the k-th tier, (tree, block, more, members). ``top_tiers``: those of the tree of subroots.
    ``subroots``: (tree, digest). ``root``: None for an empty table."""
    tiers: list[DataFrame]
    top_tiers: list[DataFrame]
    subroots: DataFrame
    root: str | None


def _blocks(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes (tree, place, size, digest, ...) as one row a block; ``more``: whether the tree has other blocks on this tier."""
    rest = [c for c in nodes.columns if c not in ("tree", "size", "place")]
    members = F.sort_array(F.collect_list(F.struct("place", *rest)))      # 4096 at most
    block = F.floor(F.col("place") / BLOCK).alias("block")
    return stored(nodes.groupBy("tree", block).agg((F.max("size") > BLOCK).alias("more"), F.max("size").alias("size"), members.alias("members")), name)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time."""
    for i in range(batch.num_rows):
        yield {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}


def _member(batch: pa.RecordBatch, name: str) -> pa.DataType:
    """Arrow's type of a field of the blocks' members."""
    members = batch.schema.field("members").type.value_type
    return members.field(members.get_field_index(name)).type


def _hex(value: bytes | None) -> str | None:
    return None if value is None else value.hex()


def _block_levels(row: dict) -> list[list[str]]:
    return climb([_hex(m["digest"]) for m in row["members"]], LEVELS if row["more"] else None)


def _block_roots(batches):
    for b in batches:
        out = [(r["tree"], r["block"], r["more"], -(-r["size"] // BLOCK), bytes.fromhex(_block_levels(r)[-1][0])) for r in _rows(b)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()))],
                                             names=["tree", "place", "more", "size", "digest"])


def _grow(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Tiers of blocks until every tree has one block, and the trees' roots (tree, digest)."""
    tiers, done = [], None
    while True:
        tiers.append(_blocks(nodes, f"{name}-tier{len(tiers)}"))
        tops = stored(tiers[-1].mapInArrow(_block_roots, "tree string, place long, more boolean, size long, digest binary"), f"{name}-roots{len(tiers)}")
        ready = tops.where("not more").select("tree", "digest")
        done = ready if done is None else done.unionByName(ready)
        nodes = tops.where("more").drop("more")
        if nodes.isEmpty():
            return tiers, done


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tampered: Column | None = None) -> DataFrame:
    """One row a document: tree (of its source), doc_id, digest and, where ``tampered`` holds, the digest of the row with
    its text's A-Z in lower case (``changed``)."""
    d = docs.select(*[F.col(f"`{c}`").alias(f"f_{c}") for c in fields])
    cols = {c: F.col(f"f_{c}") for c in fields}
    low = cols | {"text": F.translate(cols["text"].cast("string"), UPPER, UPPER.lower())}
    hit = F.lit(False) if tampered is None else tampered
    source = cols["source"].cast("string")
    return d.withColumn("doc_id", cols["doc_id"]).select(
        F.coalesce(F.concat(F.lit("1"), source), F.lit("0")).alias("tree"), "doc_id",
        F.unhex(leaf_digest(list(cols.values()))).alias("digest"),
        F.when(hit, F.unhex(leaf_digest(list(low.values())))).alias("changed"))


def build(rows: DataFrame) -> Manifest:
    """The tree over ``leaves(...)``."""
    tiers, subroots = _grow(ranked(rows, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()], "leaves"), "sources")
    named = subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("child"), "digest")
    top_tiers, top = _grow(ranked(named, "tree", [F.col("child").asc()], "subroots"), "top")
    found = top.collect()                                   # one row
    return Manifest(tiers, top_tiers, subroots, found[0]["digest"].hex() if found else None)


def _down(name: str):
    """Hand each member of a block the siblings above it: those in the block, then those above the block."""
    def run(batches):
        for b in batches:
            for r in _rows(b):
                levels = _block_levels(r)
                paths = [steps(levels, i) + r["path"] for i in range(len(r["members"]))]
                keys = [m[name] for m in r["members"]]
                for lo in range(0, len(keys), 256):
                    hi = lo + 256
                    yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * len(keys[lo:hi]), pa.string()), pa.array(keys[lo:hi], _member(b, name)), pa.array([r["top"]] * len(keys[lo:hi]), pa.binary()),
                                                      pa.array(paths[lo:hi], pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))], names=["tree", "key", "top", "path"])
    return run


def _paths(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest tier's blocks with the siblings above each (``path``) and the digest of its tree's root (``top``).
    ``above``: the same of each whole tree, (tree, top, path)."""
    schema = T.StructType([T.StructField("tree", T.StringType()), T.StructField("key", T.LongType()), T.StructField("top", T.BinaryType()), T.StructField("path", PATH)])
    found = None
    for k in reversed(range(len(tiers))):
        whole = tiers[k].where("not more").join(above, "tree")
        rest = tiers[k].where("more") if found is not None else None
        if rest is not None:
            got = found.withColumnRenamed("key", "block")
            whole = whole.unionByName(rest.join(got, ["tree", "block"]))
        if k == 0:
            return whole
        found = stored(whole.mapInArrow(_down("place"), schema), "paths")


def _above(m: Manifest) -> DataFrame:
    """For each source: its subroot and the siblings up to the root."""
    spark = m.subroots.sparkSession
    start = spark.createDataFrame([(TOP, None, [])], T.StructType([T.StructField("tree", T.StringType()), T.StructField("top", T.BinaryType()), T.StructField("path", PATH)]))
    schema = T.StructType([T.StructField("tree", T.StringType()), T.StructField("key", T.StringType()), T.StructField("top", T.BinaryType()), T.StructField("path", PATH)])
    given = _paths(m.top_tiers, start).mapInArrow(_down("child"), schema).select(F.col("key").alias("tree"), "path")
    return stored(m.subroots.withColumnRenamed("digest", "top").join(given, "tree"), "above")


def _id_type(m: Manifest) -> str:
    return m.tiers[0].schema["members"].dataType.elementType["doc_id"].dataType.simpleString()


def proofs(m: Manifest) -> DataFrame:
    """A row for each leaf: doc_id, leaf, subroot, root, proof_sha256 (of the siblings' digests up to the root, joined), folded_root (from the
    changed leaf where there is one) and verified. Empty for an empty table."""
    root = m.root
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches):
        for b in batches:
            for r in _rows(b):
                levels, out = _block_levels(r), []
                upper = "".join(s["before"] + s["after"] for s in r["path"]).encode()
                for i, x in enumerate(r["members"]):
                    own = steps(levels, i)
                    proof = hashlib.sha256("".join(s["before"] + s["after"] for s in own).encode())
                    proof.update(upper)
                    start = _hex(x["changed"] or x["digest"])
                    folded = (fold(start, own + r["path"]) or [start])[-1]
                    out.append((x["doc_id"], _hex(x["digest"]), r["top"].hex(), root, proof.hexdigest(), folded, folded == root))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], _member(b, "doc_id"))] + [pa.array(c, pa.string()) for c in cols[1:6]] + [pa.array(cols[6], pa.bool_())], names=names)

    schema = f"doc_id {_id_type(m)}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _paths(m.tiers, _above(m)).mapInArrow(run, schema)


def nodes(m: Manifest) -> DataFrame:
    """Every node of the base: (tree, level, index, digest); the subroots' tree is named ``top``, those of sources ``1`` and the source
    or ``0``. A block's root is listed as a leaf of the next tier's block, or as the tree's last node."""
    def run(tier):
        def go(batches):
            for b in batches:
                for r in _rows(b):
                    levels = _block_levels(r)
                    for k, level in enumerate(levels[:LEVELS] if r["more"] else levels):
                        n = len(level)
                        yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * n, pa.string()), pa.array([LEVELS * tier + k] * n, pa.int32()),
                                                          pa.array([r["block"] * FANOUT ** (LEVELS - k) + i for i in range(n)], pa.int64()), pa.array(level, pa.string())], names=["tree", "level", "index", "digest"])
        return go

    out = None
    for tiers in (m.tiers, m.top_tiers):
        for k, blocks in enumerate(tiers):
            one = blocks.mapInArrow(run(k), "tree string, level int, index long, digest string")
            out = one if out is None else out.unionByName(one)
    return out


def versions(m: Manifest) -> DataFrame:
    """The copies that the changed leaves make: (doc_id, source_tree, step, digest), ``step`` 0 for the leaf and counting upwards to the root, the
    last one. Every node that is not listed is shared with the base."""
    def run(batches):
        for b in batches:
            for r in _rows(b):
                levels, out = _block_levels(r), []
                for i, x in enumerate(r["members"]):
                    if x["changed"] is not None:
                        start = _hex(x["changed"])
                        out += [(x["doc_id"], r["tree"], k, d) for k, d in enumerate([start, *fold(start, steps(levels, i) + r["path"])])]
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], _member(b, "doc_id")), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())],
                                                     names=["doc_id", "source_tree", "step", "digest"])

    return _paths(m.tiers, _above(m)).mapInArrow(run, f"doc_id {_id_type(m)}, source_tree string, step int, digest string")
