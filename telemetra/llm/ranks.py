"""Places of rows within their group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import stored


def ranked(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``place`` (0-based, by ``order`` within ``group``) and ``size`` (rows of the group).

    The rows are dealt by ranges of (group, order), so a group that holds most of the table spreads over many tasks. Rows are
    numbered within a task; what earlier tasks hold of the same group is one row a task and group. ``group`` must not be null. Rows equal in
    ``order`` get different places; give enough columns where it matters which. The table is stored under ``name``, so places stay as
    they are when an executor is lost.
    """
    keys = [F.col(group).asc(), *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    dealt = stored(dealt.withColumn("__part", F.shiftright("__at", 33)), name)
    runs = dealt.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__g")
    earlier = F.coalesce(F.sum("__n").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("__g", "__p", (F.col("__first") - earlier).alias("__shift"), F.sum("__n").over(w).alias("size"))
    out = dealt.join(runs, (F.col(group) == F.col("__g")) & (F.col("__part") == F.col("__p")))
    return out.withColumn("place", F.col("__at") - F.col("__shift")).drop("__g", "__p", "__shift", "__at", "__part")
