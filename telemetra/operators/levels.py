"""Averages over several levels at once: subtotals along a hierarchy, or over every choice of dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..functions.columns import nan_to_null


def multi_level(df: DataFrame, dims: list[str], value: str = C.TEMPERATURE, how: str = "rollup") -> DataFrame:
    """Count, mean, minimum and maximum of ``value`` for ``dims`` and their subtotals: ``rollup`` drops dimensions from the right one by one, ``cube``
    drops each choice of them. ``grouping_id`` tells a subtotal (its bit is 1) from a dimension that is NULL itself.

    The readings are summed once, at the finest level and map-side; only those sums, one row a group, are multiplied by the levels and
    shuffled. Means come from sums and counts, so levels add up. NULL and NaN values are missing: a group without a value has
    count 0 and no mean. An empty table has no rows, not even a grand total.
    """
    if how not in ("rollup", "cube"):
        raise ValueError("how must be 'rollup' or 'cube'")
    v = nan_to_null(F.col(value).cast("double"))
    fine = df.groupBy(*dims).agg(F.count(v).alias("_n"), F.sum(v).alias("_s"), F.min(v).alias("_i"), F.max(v).alias("_a"))
    out = getattr(fine, how)(*dims).agg(F.grouping_id().alias("grouping_id"), F.sum("_n").alias("n_values"), F.sum("_s").alias("_s"),
                                        F.min("_i").alias("min_value"), F.max("_a").alias("max_value"), F.count(F.lit(1)).alias("_rows"))
    # an empty table has a grand total of its own; it says nothing
    out = out.filter("_rows > 0").withColumn("avg_value", F.when(F.col("n_values") > 0, F.col("_s") / F.col("n_values")))
    return out.select(*dims, "grouping_id", "n_values", "avg_value", "min_value", "max_value")
