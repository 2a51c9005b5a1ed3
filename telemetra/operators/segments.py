"""Ordered per-device scans that do not put a whole device into one task.

A plain ``Window.partitionBy(device)`` sends every reading of a device to one task, so a device that
owns a third of the data would own a third of the cluster's work in one task. Instead each device's
history is cut into time segments of about equal numbers of rows: rows are windowed by ``(device, segment)``, and whatever has to
cross a segment edge (row offsets, last/next known values, the rows just before or after) travels
through a *summary* with one row per ``(device, segment)``. The summary is scanned by a small window
per device and joined back on ``(device, segment)``.

Plan shape: the rows are shuffled once, by ``(device, segment)``; both window passes, the summary
aggregation and the join back reuse that partitioning. Only the summary moves again.

The windowed rows feed two consumers (the summary and the join back). Spark would evaluate a shared
sub-plan twice (scan and shuffle included), so ``known_neighbours`` persists the windowed rows once
(memory, spilling to local disk; a lost block is recomputed from lineage). Later scans built on top
of them re-read that copy instead of the source; ``released`` frees the copies made within a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config as C
from ..functions.columns import epoch_micros

SEG = "_seg"
LPOS = "_lpos"
# Rows without a timestamp sort after all others: their segments follow this one.
LAST_SEGMENT = 2 ** 62
# Cuts of a key at most, and the accuracy of a quantile: a segment holds 1 / 512 of its key's rows, give or take 1 / 2500.
QUANTILES = 512
QUANTILE_ACCURACY = 5000


_held: list[list[DataFrame]] = []


@contextmanager
def released() -> Iterator[None]:
    """Frames that the scans of this block persist are released at its end; store what is needed beyond it."""
    _held.append([])
    try:
        yield
    finally:
        for d in _held.pop():
            d.unpersist()


def _kept(df: DataFrame) -> DataFrame:
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if _held:
        _held[-1].append(df)
    return df


def segment_bounds(df: DataFrame, key: str = C.DEVICE, ts: str = C.TIMESTAMP,
                   target_rows: int | None = None) -> DataFrame:
    """Per key, the times (microseconds, ascending) at which its history is cut, so that each segment holds at most about
    ``target_rows`` rows however unevenly they lie in time: every so many of its ``QUANTILES`` quantiles. A sparse device has no
    cut, a burst gets as many as its rows ask for. ``_parts``: into how many even stretches of time a segment is cut further, 1 up
    to ``QUANTILES`` times the target. One aggregate by key, combined map-side; all cuts together are at most rows / target * 2.
    """
    target_rows = target_rows or C.TARGET_SEGMENT_ROWS
    micros = epoch_micros(ts, df.schema[ts].dataType)
    share = [q / QUANTILES for q in range(1, QUANTILES)]
    stats = (df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
             .groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(micros, share, QUANTILE_ACCURACY).alias("_p"),
                               F.min(micros).alias("_lo"), F.max(micros).alias("_hi")))
    wanted = F.ceil(F.col("_n") / F.lit(target_rows))
    step = F.greatest(F.lit(1), F.floor(QUANTILES / wanted)).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), F.floor((QUANTILES - 1) / step).cast("int")), lambda i: F.get("_p", (i * step - 1).cast("int")))
    return stats.select(key, F.when(wanted > 1, F.array_distinct(cuts)).alias("_cuts"), F.ceil(wanted / QUANTILES).alias("_parts"), "_lo", "_hi")


def _number(micros: Column) -> Column:
    """The segment of a time, from its key's row of ``segment_bounds``: the number of cuts at or before it, by halving."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(QUANTILES.bit_length()))])
    at = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.aggregate(
        steps, F.lit(0), lambda n, s: F.when(F.get("_cuts", n + s - 1) <= micros, n + s).otherwise(n)))
    low, high = F.coalesce(F.get("_cuts", at - 1), F.col("_lo")), F.coalesce(F.get("_cuts", at), F.col("_hi") + 1)
    part = F.least(F.col("_parts") - 1, F.floor((micros - low).cast("double") / (high - low) * F.col("_parts")))
    return at.cast("long") * F.col("_parts") + F.when(F.col("_parts") > 1, part).otherwise(0)


def add_segment(df: DataFrame, ts: str = C.TIMESTAMP, seconds: int | None = C.DEFAULT_SEGMENT_SECONDS,
                key: str = C.DEVICE) -> DataFrame:
    """Add the segment number unless the frame already has one.

    ``seconds``: a fixed width for every key, or ``None`` for cuts by counted rows (``segment_bounds``), joined to the rows without a
    hint: the same method for any number of keys, the engine choosing how to join by measured bytes. Rows without a time come last,
    in order of the tie column: they are cut by ranges of it.
    """
    if SEG in df.columns:
        return df
    micros = epoch_micros(ts, df.schema[ts].dataType)
    late = F.lit(LAST_SEGMENT)
    if C.READING_ID in df.columns and df.schema[C.READING_ID].dataType.simpleString() in ("bigint", "int"):
        late = late + F.coalesce(F.floor(F.col(C.READING_ID) / C.TARGET_SEGMENT_ROWS), F.lit(LAST_SEGMENT // 2))
    if seconds is not None:
        return df.withColumn(SEG, F.coalesce(F.floor(micros / F.lit(seconds * 1_000_000)), late))
    d = df.join(segment_bounds(df, key, ts), key, "left")
    return d.withColumn(SEG, F.coalesce(F.when(micros.isNotNull(), _number(micros)), late)).select(*df.columns, SEG)


def _asc(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def _desc(order: list[str]) -> list[Column]:
    return [F.col(c).desc_nulls_first() for c in order]


def _f(c: str) -> str:
    return f"_fwd_{c}"


def _b(c: str) -> str:
    return f"_bwd_{c}"


def known_neighbours(df: DataFrame, cols: list[str], key: str = C.DEVICE,
                     order: list[str] = (C.TIMESTAMP, C.READING_ID),
                     seconds: int | None = C.DEFAULT_SEGMENT_SECONDS, backward: bool = True,
                     persist: bool = True) -> DataFrame:
    """For each row and column: the last known value at or before it and the next known value at or
    after it, with their positions in the key's ordered history.

    Adds ``_gpos`` (1-based position within the key), ``_prev_<c>`` and, if ``backward``,
    ``_next_<c>`` as ``struct<v, p>`` (value, position); NULL where no such value exists.
    Keeps ``_seg`` so a following scan can reuse the partitioning.
    """
    order = list(order)
    d = add_segment(df, order[0], seconds, key=key)
    w = Window.partitionBy(key, SEG).orderBy(*_asc(order))
    up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn(LPOS, F.row_number().over(w))

    def known(c):
        return F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col(LPOS).alias("p")))

    d = d.select("*", *[F.last(known(c), ignorenulls=True).over(up).alias(_f(c)) for c in cols])
    if backward:
        down = (Window.partitionBy(key, SEG).orderBy(*_desc(order))
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        d = d.select("*", *[F.last(known(c), ignorenulls=True).over(down).alias(_b(c)) for c in cols])
    if persist:
        d = _kept(d)

    # One row per (key, segment): its size, its last known values and (backward) its first ones.
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.max_by(F.col(_f(c)), F.col(LPOS)).alias(_f(c)) for c in cols]
    if backward:
        aggs += [F.min_by(F.col(_b(c)), F.col(LPOS)).alias(_b(c)) for c in cols]
    summary = d.groupBy(key, SEG).agg(*aggs)

    sw = Window.partitionBy(key).orderBy(F.col(SEG).asc())
    before = sw.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))

    def globalised(s):
        return F.when(F.col(s).isNotNull(),
                      F.struct(F.col(s + ".v").alias("v"), (F.col(s + ".p") + F.col("_off")).alias("p")))

    carry = [F.last(globalised(_f(c)), ignorenulls=True).over(before).alias(f"_cprev_{c}") for c in cols]
    if backward:
        after = (Window.partitionBy(key).orderBy(F.col(SEG).desc())
                 .rowsBetween(Window.unboundedPreceding, -1))
        carry += [F.last(globalised(_b(c)), ignorenulls=True).over(after).alias(f"_cnext_{c}")
                  for c in cols]
    summary = summary.select(key, SEG, "_off", *carry)

    out = d.join(summary, [key, SEG], "left")
    off = F.col("_off")
    res = [F.when(F.col(key).isNotNull(), off + F.col(LPOS)).alias("_gpos")]
    for c in cols:
        local = F.when(F.col(_f(c)).isNotNull(),
                       F.struct(F.col(_f(c) + ".v").alias("v"), (F.col(_f(c) + ".p") + off).alias("p")))
        res.append(F.coalesce(local, F.col(f"_cprev_{c}")).alias(f"_prev_{c}"))
        if backward:
            local = F.when(F.col(_b(c)).isNotNull(),
                           F.struct(F.col(_b(c) + ".v").alias("v"), (F.col(_b(c) + ".p") + off).alias("p")))
            res.append(F.coalesce(local, F.col(f"_cnext_{c}")).alias(f"_next_{c}"))
    helpers = {LPOS, "_off"} | {_f(c) for c in cols} | {_b(c) for c in cols} \
        | {f"_cprev_{c}" for c in cols} | {f"_cnext_{c}" for c in cols}
    keep = [F.col(c) for c in out.columns if c not in helpers]
    return out.select(*keep, *res)


def neighbour_rows(df: DataFrame, value: str, key: str = C.DEVICE,
                   order: list[str] = (C.TIMESTAMP, C.READING_ID),
                   seconds: int | None = C.DEFAULT_SEGMENT_SECONDS, lead_col: str | None = C.TIMESTAMP,
                   persist: bool = False) -> DataFrame:
    """The two rows before and the row after each row, in key order, across segment edges.

    Adds ``_lag1``/``_lag2`` (``value`` one and two rows back) and ``_lead`` (``lead_col`` one
    row ahead); NULL at the ends of a key's history and for rows without a key.
    """
    order = list(order)
    d = add_segment(df, order[0], seconds, key=key)
    w = Window.partitionBy(key, SEG).orderBy(*_asc(order))
    d = d.withColumn(LPOS, F.row_number().over(w))
    d = d.select("*", F.lag(value, 1).over(w).alias("_l1"), F.lag(value, 2).over(w).alias("_l2"),
                 *([F.lead(lead_col, 1).over(w).alias("_nl")] if lead_col else []))
    if persist:
        d = _kept(d)

    aggs = [F.count(F.lit(1)).alias("_n"),
            F.max_by(F.struct(F.col("_l1").alias("a"), F.col(value).alias("b")), F.col(LPOS)).alias("_tail")]
    if lead_col:
        aggs.append(F.min_by(F.col(lead_col), F.col(LPOS)).alias("_head"))
    summary = d.groupBy(key, SEG).agg(*aggs)
    sw = Window.partitionBy(key).orderBy(F.col(SEG).asc())
    prev_n = F.lag("_n", 1).over(sw)
    carry = [F.lag("_tail.b", 1).over(sw).alias("_p1"),
             F.when(prev_n >= 2, F.lag("_tail.a", 1).over(sw))
              .otherwise(F.lag("_tail.b", 2).over(sw)).alias("_p2")]
    if lead_col:
        carry.append(F.lead("_head", 1).over(sw).alias("_h1"))
    summary = summary.select(key, SEG, F.col("_n").alias("_segn"), *carry)

    out = d.join(summary, [key, SEG], "left")
    pos = F.col(LPOS)
    has_key = F.col(key).isNotNull()
    res = [F.when(has_key, F.when(pos >= 2, F.col("_l1")).otherwise(F.col("_p1"))).alias("_lag1"),
           F.when(has_key, F.when(pos >= 3, F.col("_l2")).when(pos == 2, F.col("_p1"))
                  .otherwise(F.col("_p2"))).alias("_lag2")]
    if lead_col:
        res.append(F.when(has_key, F.when(pos == F.col("_segn"), F.col("_h1"))
                          .otherwise(F.col("_nl"))).alias("_lead"))
    helpers = {LPOS, "_l1", "_l2", "_nl", "_segn", "_p1", "_p2", "_h1"}
    keep = [F.col(c) for c in out.columns if c not in helpers]
    return out.select(*keep, *res)
