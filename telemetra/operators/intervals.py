"""Joins of intervals with intervals: which stretches of time of one table overlap which of another.

Each interval lies on a level by its length: the level's buckets are at least as long, so it touches two of them at most. Two intervals that overlap
meet on the level of the longer one. An interval is therefore listed in its own buckets, and in the one or two buckets of each longer level that
the other table uses: at most two rows a level, with a level for every fourfold length, however long the interval or its neighbours are. The
join is by equal (key, level, bucket), so a hot key spreads over its buckets and a key with one very long interval costs the others one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import epoch_micros

STEP = 2                # a level's buckets are 2**STEP times as long as those of the level below
TOP = 60                # the level of intervals without an end; its buckets are 2**60 microseconds long


def _level(length: Column) -> Column:
    """The lowest level whose buckets are at least ``length`` microseconds long; NULL for an open interval is the top level."""
    fitting = [F.when(length <= F.lit(1 << k), F.lit(k)) for k in range(0, TOP, STEP)]
    return F.coalesce(*fitting, F.lit(TOP))


def _bucket(t: Column, level: Column) -> Column:
    return F.call_function("shiftright", t, level)


def _sided(df: DataFrame, start: str, end: str, closed: bool) -> DataFrame:
    """(_row, _s, _e, _own): the row, its interval in microseconds and its level. Rows without a start, or that end before they begin, hold no time."""
    s, e = epoch_micros(start, df.schema[start].dataType), epoch_micros(end, df.schema[end].dataType)
    d = df.select(F.struct("*").alias("_row"), s.alias("_s"), (e + 1 if closed else e).alias("_e"))
    d = d.filter(F.col("_s").isNotNull() & (F.col("_e").isNull() | (F.col("_e") > F.col("_s"))))
    return d.withColumn("_own", _level(F.col("_e") - F.col("_s")))


def _listed(d: DataFrame, levels: Column) -> DataFrame:
    """One row a level of ``levels`` and bucket that the interval touches there."""
    d = d.select("*", F.explode(levels).alias("_level"))
    first = _bucket(F.col("_s"), F.col("_level"))
    last = F.when(F.col("_e").isNull(), first + 1).otherwise(_bucket(F.col("_e") - 1, F.col("_level")))
    return d.select("*", F.explode(F.sequence(first, last)).alias("_bucket"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], closed: bool = False) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose intervals [start, end) overlap: structs ``left`` and ``right``, and ``overlap_micros``
    (NULL where neither ends).

    A NULL end is an interval that goes on; rows without a start, or whose end is not after the start, match nothing (``closed``: ends belong to the
    intervals, so an interval may be one instant). NULL keys match nothing. Repeated rows match each. Times are compared to the microsecond.
    """
    a, b = _sided(left, *left_span, closed), _sided(right, *right_span, closed)
    used = {side: sorted(r[0] for r in d.select("_own").distinct().collect()) for side, d in (("a", a), ("b", b))}        # 31 levels at most

    def higher(levels: list[int], strictly: bool) -> Column:
        own = F.col("_own")
        all_ = F.array(*[F.lit(k) for k in levels]).cast("array<int>")
        return F.filter(all_, lambda k: k > own if strictly else k >= own)

    def named(d: DataFrame, side: str) -> DataFrame:
        return d.select(*[F.col(f"_row.`{k}`").alias(k) for k in keys], F.col("_level"), F.col("_bucket"), F.col("_row").alias(side),
                        F.col("_s").alias(f"_s{side}"), F.col("_e").alias(f"_e{side}"))

    own = F.array(F.col("_own"))
    pairs = []
    # the left one is at least as long; then the right one is longer
    for long_, short, names, levels, strictly in ((a, b, ("left", "right"), used["a"], False), (b, a, ("right", "left"), used["b"], True)):
        met = named(_listed(long_, own), names[0]).join(named(_listed(short, higher(levels, strictly)), names[1]), [*keys, "_level", "_bucket"])
        pairs.append(met.select("_level", "_bucket", "left", "right", "_sleft", "_eleft", "_sright", "_eright"))
    both = pairs[0].unionByName(pairs[1])
    begin, end = F.greatest("_sleft", "_sright"), F.least("_eleft", "_eright")          # least skips the NULL of an open end
    both = both.filter((end.isNull() | (begin < end)) & (F.col("_bucket") == _bucket(begin, F.col("_level"))))      # a pair meets in up to two buckets
    return both.select("left", "right", (end - begin).alias("overlap_micros"))
