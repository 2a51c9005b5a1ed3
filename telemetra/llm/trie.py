"""Prefix trie of conversations by collapsing whole sequences.

Each conversation is a sequence of turns. Identical sequences become one, weighted by its conversations, whose ids are its end list. Sequences that
are a proper prefix of another one are found by an anti join; the others are the trie's leaves. The nodes are the weighted prefixes of the distinct
sequences, summed by prefix; no conversation is held as one value and no trie is built in memory.

A prefix is named by 128 bits: two exclusive-or sums of 64-bit hashes of (position, role, text). Such sums are added up in any order, so a
conversation of any length is cut into stretches that are summed apart. Two different prefixes share a name with probability of about 2**-128.

Sums over a subtree come from the sequences below a node, not from walking it. Every node is owned by the conversation with the smallest id in it;
what a sequence owns is its end from some depth on. So the bytes of the distinct nodes of a subtree are what its sequences own, the owner of the
subtree's top counted from that top on only.

Defined results: null role or text is empty text; turns that share a turn number (or have none; these come first) are ordered by role, then by
the text's digest, and repeated rows are turns of their own. Rows without a conv_id belong to no conversation and are left out. An empty table has no
nodes, not even a root. A conversation may be left turnless; it ends at the root. Ids below zero belong
to the group at the multiple next to zero, as remainders in SQL have it. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranks import ranked
from .tables import stored

STRETCH = 4096                          # turns of a conversation that are summed together
CHUNK = 4096                            # ids of an end list that are joined together
NAME = ["p1", "p2"]
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(table: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns in order, from place 0."""
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = table.where("conv_id is not null").select("conv_id", F.col("turn").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    # two hashes and a length stand for the text from here on
    slim = rows.select("conv_id", "turn", "role", F.octet_length("text").cast("long").alias("bytes"),
                       F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "text", "role").alias("b"), F.md5("text").alias("t"))
    return ranked(slim, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("t").asc()], "turns").drop("turn", "t", "role")


def rebuilt(ordered: DataFrame, group: int = 5, shared: int = 9) -> DataFrame:
    """Conversations as they go on from the first one of their group: the first h turns of conversation c - c % ``group``, then c's own
    after its first h, h = crc32(c) % ``shared``. Rows (conv_id, depth from 1, bytes, a, b); turnless conversations have none."""
    own = ordered.withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared)))
    sizes = own.where("place = 0").select("conv_id", "h", F.col("size"))
    first = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    convs = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(first, "base", "left")
    convs = convs.select("conv_id", "base", "h", F.least(F.coalesce("base_size", F.lit(0)), "h").alias("lead"))
    # only the first few turns of a base conversation can be shared, with few others
    heads = ordered.where(F.col("place") < shared - 1).select(F.col("conv_id").alias("base"), "place", "bytes", "a", "b")
    lead = convs.join(heads, "base").where("place < lead").select("conv_id", (F.col("place") + 1).alias("depth"), "bytes", "a", "b")
    tails = own.where("place >= h").join(convs.select("conv_id", "lead"), "conv_id")
    tails = tails.select("conv_id", (F.col("place") - F.col("h") + F.col("lead") + 1).alias("depth"), "bytes", "a", "b")
    return lead.unionByName(tails)


def prefixes(turns_of: DataFrame) -> DataFrame:
    """Each turn with the name of the prefix that it ends (p1, p2), of the prefix before it (q1, q2), and the conversation's bytes up to it (``upto``)."""
    rows = turns_of.select("conv_id", "depth", "bytes", F.xxhash64("depth", "a").alias("x1"), F.xxhash64("b", "depth").alias("x2"),
                           F.floor(F.col("depth") / STRETCH).alias("stretch"))
    w = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inner = stored(rows.withColumn("i1", F.bit_xor("x1").over(w)).withColumn("i2", F.bit_xor("x2").over(w)).withColumn("ib", F.sum("bytes").over(w)), "stretches")
    sums = inner.groupBy("conv_id", "stretch").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"), F.sum("bytes").alias("sb"))
    back = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    # conversations of one stretch need nothing from before
    more = sums.withColumn("n", F.max("stretch").over(Window.partitionBy("conv_id"))).where("n > 0")
    more = more.select("conv_id", "stretch", *[F.coalesce(f(c).over(back), F.lit(0)).alias(o) for f, c, o in ((F.bit_xor, "s1", "o1"), (F.bit_xor, "s2", "o2"), (F.sum, "sb", "ob"))])
    both = inner.join(more, ["conv_id", "stretch"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = both.select("conv_id", "depth", "bytes", "x1", "x2", F.col("i1").bitwiseXOR(zero("o1")).alias("p1"),
                       F.col("i2").bitwiseXOR(zero("o2")).alias("p2"), (F.col("ib") + zero("ob")).alias("upto"))
    return both.select("conv_id", "depth", "bytes", "upto", *NAME, F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"))


def sequences(convs: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ends, sequences). Ends: (conv_id, p1, p2), the whole sequence of each conversation. Sequences: the distinct ones, each with its
    smallest conversation, its weight (conversations), depth and bytes."""
    last = steps.groupBy("conv_id").agg(F.max(F.struct("depth", *NAME, "upto")).alias("z"))
    zero = F.lit(0).cast("long")
    ends = convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(f"z.{c}"), zero).alias(o) for c, o in (("p1", "p1"), ("p2", "p2"), ("depth", "depth"), ("upto", "total"))])
    ends = stored(ends, "ends")
    whole = ends.groupBy("depth", *NAME).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.min("total").alias("total"))
    return ends, stored(whole, "sequences")


def end_lists(ends: DataFrame) -> DataFrame:
    """For each prefix at which conversations end: SHA-256 of their ids, ascending, joined by commas. Ids are joined in chunks wherever they lie;
    a list of several chunks passes through one digest chunk after chunk, as SHA-256 demands."""
    named = ends.select(F.concat_ws(" ", *NAME, "depth").alias("end"), "conv_id")
    placed = ranked(named, "end", [F.col("conv_id").asc()], "end-lists")
    part = F.floor(F.col("place") / CHUNK).alias("part")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = placed.groupBy("end", part).agg(ids.alias("ids"), F.max("size").alias("size"))
    small = parts.where(F.col("size") <= CHUNK).select("end", F.sha2("ids", 256).alias("ends_sha256"))
    large = parts.where(F.col("size") > CHUNK).select("end", "part", "ids").repartition("end").sortWithinPartitions("end", "part").mapInArrow(_digest_lists, "end string, ends_sha256 string")
    return small.unionByName(large)


def _digest_lists(batches):
    """Rows (end, part, ids) in order: one digest an end. Holds one batch and one digest."""
    now, digest, out = None, None, []
    for b in batches:
        for end, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if end != now:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = end, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["end", "ends_sha256"])
            out = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["end", "ends_sha256"])


def nodes(convs: DataFrame, turns_of: DataFrame) -> DataFrame:
    """The nodes of the trie of the conversations ``convs`` (conv_id, once each) with turns ``turns_of`` (conv_id, depth from 1, bytes, a, b).

    Columns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    steps = prefixes(turns_of)
    ends, whole = sequences(convs, steps)
    seq = whole.select("conv_id", "weight", F.col("depth").alias("length"), "total")
    zero = F.lit(0).cast("long")
    # the prefixes of one conversation of each distinct sequence, and the textless one of all
    own = steps.join(seq, "conv_id").select("conv_id", "weight", "length", "total", "depth", "bytes", "upto", *NAME, "q1", "q2")
    top = seq.select("conv_id", "weight", "length", "total", *[zero.alias(c) for c in ("depth", "bytes", "upto", *NAME)], F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"))
    weighted = stored(own.unionByName(top), "prefixes")
    rest = F.col("total") - F.col("upto") + F.col("bytes")           # bytes from the node on
    found = stored(weighted.groupBy("depth", *NAME).agg(
        F.min("conv_id").alias("conv_id"), F.min_by(rest, "conv_id").alias("rest"), F.sum("weight").alias("n_convs"), F.sum(F.col("weight") * rest).alias("read"),
        F.min("bytes").alias("bytes"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.max(F.col("length") > F.col("depth")).alias("inner")), "nodes")
    leaves = whole.join(found.where("inner"), ["depth", *NAME], "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    owned = found.groupBy("conv_id").agg(F.sum("bytes").alias("owned"))
    each = stored(seq.select("conv_id").join(owned, "conv_id", "left").join(leaves, "conv_id", "left").select(
        "conv_id", F.coalesce("owned", F.lit(0)).alias("owned"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "owned")
    below = weighted.select("conv_id", "depth", *NAME).join(each, "conv_id").groupBy("depth", *NAME).agg(F.sum("owned").alias("owned"), F.sum("leaf").alias("n_leaves"))
    kids = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    mine = each.select(F.col("conv_id").alias("o"), F.col("owned").alias("owners"))
    full = found.join(below, ["depth", *NAME]).join(kids, ["depth", *NAME], "left").join(mine, F.col("conv_id") == F.col("o"))
    # bytes of the distinct nodes below: what other sequences own there, and what the owner has from here on
    distinct = F.col("owned") - F.col("owners") + F.col("rest")
    full = stored(full.select("conv_id", "depth", *NAME, "q1", "q2", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
                              (F.col("read") - distinct).alias("saved_tokens")), "counted")
    parents = full.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    lists = end_lists(ends.select("conv_id", "depth", *NAME))
    out = full.join(parents, ["depth", "q1", "q2"], "left").withColumn("end", F.concat_ws(" ", *NAME, "depth")).join(lists, "end", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def conversation_trie(table: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``table`` (conv_id, turn, role, text)."""
    ordered = stored(turns(table), "ordered")
    convs = ordered.where("place = 0").select("conv_id")
    return nodes(convs, rebuilt(ordered))
