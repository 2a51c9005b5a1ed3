"""Two tables that should hold the same rows: what one has more often than the other, and in which columns rows of one key differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ONLY_LEFT, ONLY_RIGHT = "only_left", "only_right"


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """The columns of ``left`` plus ``side`` and ``copies``: each distinct row that one side holds more often, and by how many copies
    (``EXCEPT ALL`` both ways at once). NULL equals NULL, NaN equals NaN, -0.0 equals 0.0; an empty side lacks everything.

    One aggregate over both, combined map-side: a row repeated a million times is one row a task. Both tables must have the same columns, in any order.
    """
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {sorted(set(left.columns) ^ set(right.columns))}")
    cols = [F.col(f"`{c}`") for c in left.columns]
    both = left.select(*cols, F.lit(1).cast("long").alias("__n")).union(right.select(*cols, F.lit(-1).cast("long").alias("__n")))
    more = both.groupBy(*cols).agg(F.sum("__n").alias("copies")).filter("copies <> 0")
    return more.withColumn("side", F.when(F.col("copies") > 0, ONLY_LEFT).otherwise(ONLY_RIGHT)).withColumn("copies", F.abs("copies"))


def reconciliation(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(finding, column_name, rows): ``missing`` and ``extra`` copies in ``right`` of keys or repeats that the other side lacks, and for keys that
    have one unmatched row on each side the columns in which those differ (``changed``). Findings without rows are listed with 0.

    Keys with several unmatched rows on a side cannot be paired off and count as missing and extra. NULL keys match NULL keys.
    """
    rest = multiset_difference(left, right)
    others = [c for c in left.columns if c not in keys]
    side = lambda s: F.col("side") == s
    first = lambda s, c: F.min(F.when(side(s), F.struct(F.col(f"`{c}`").alias("v")))).alias(f"{s}_{c}")
    by_key = rest.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.sum(F.when(side(ONLY_LEFT), F.col("copies")).otherwise(0)).alias("__l"), F.sum(F.when(side(ONLY_RIGHT), F.col("copies")).otherwise(0)).alias("__r"),
        *[first(s, c) for s in (ONLY_LEFT, ONLY_RIGHT) for c in others])
    pair = (F.col("__l") == 1) & (F.col("__r") == 1)
    differ = [F.count_if(pair & ~F.col(f"`{ONLY_LEFT}_{c}`.v").eqNullSafe(F.col(f"`{ONLY_RIGHT}_{c}`.v"))).alias(f"c{i}") for i, c in enumerate(others)]
    total = lambda c: F.coalesce(F.sum(F.when(~pair, F.col(c))), F.lit(0)).cast("long")
    one = by_key.agg(total("__l").alias("missing"), total("__r").alias("extra"), *differ)
    lines = [F.struct(F.lit(f).alias("finding"), F.lit(None).cast("string").alias("column_name"), F.col(f).alias("rows")) for f in ("missing", "extra")]
    lines += [F.struct(F.lit("changed").alias("finding"), F.lit(c).alias("column_name"), F.col(f"c{i}").alias("rows")) for i, c in enumerate(others)]
    return one.select(F.explode(F.array(*lines)).alias("x")).select("x.*")
