"""Mergeable summaries of a day: how many distinct values, and their quantiles, for any longer time without reading the readings again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..functions.columns import nan_to_null

LG_K = 12           # HyperLogLog with 2**12 registers: 1.6 % standard error, at most some 4 KB
KLL_K = 200         # quantile sketch: rank error of about 1.3 %, at most a few KB


def daily_sketches(readings: DataFrame, value: str = C.TEMPERATURE) -> DataFrame:
    """(device_id, date, n_values, distinct_sketch, quantile_sketch) of the values that are there; NULL and NaN are missing. Readings without a
    device or a time are left out. Sketches are built map-side, so a hot device sends a few KB a task."""
    v = nan_to_null(F.col(value).cast("double"))
    placed = readings.filter(F.col(C.DEVICE).isNotNull() & F.col(C.TIMESTAMP).isNotNull())
    return placed.groupBy(C.DEVICE, F.to_date(C.TIMESTAMP).alias(C.DATE)).agg(
        F.count(v).alias("n_values"), F.hll_sketch_agg(v.cast("string"), F.lit(LG_K)).alias("distinct_sketch"), F.kll_sketch_agg_double(v, F.lit(KLL_K)).alias("quantile_sketch"))


def merge_sketches(sketches: DataFrame, *by) -> DataFrame:
    """The sketches of each group of ``by``, as if built from its readings."""
    return sketches.groupBy(*by).agg(F.sum("n_values").alias("n_values"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
                                     F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"))


def estimates(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """The sketches' estimates beside the other columns: ``n_distinct`` and a column for each quantile, NULL for a group without a value."""
    rest = [c for c in sketches.columns if not c.endswith("_sketch")]
    some = F.col("n_values") > 0
    return sketches.select(*rest, F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"),
                           *[F.when(some, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(q))).alias(n) for n, q in quantiles.items()])
