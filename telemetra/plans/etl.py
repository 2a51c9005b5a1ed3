"""The end-to-end run: load → (date filter) → clean → transform → classify → daily stats → store.

The classified rows are stored once in the shared folder; anomalies, daily statistics, metrics and any sink read them
from there, so the ordered scans run once for all outputs and nothing stays persisted after the run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..operators.anomaly import anomalies, classify
from ..operators.cleaning import clean
from ..operators.derive import transform
from ..operators.filters import date_range_filter
from ..operators.rollups import daily_stats
from ..operators.segments import released
from ..session import scratch_path


@dataclass
class RunResult:
    classified: DataFrame
    anomalies: DataFrame
    daily: DataFrame
    loaded: DataFrame

    def metrics(self) -> dict:
        """Rows loaded, kept, dropped and flagged, counted now."""
        kept = self.classified.agg(F.count(F.lit(1)).alias("rows_kept"), F.count_if(F.col(C.IS_ANOMALY)).alias("anomalies")).first()
        loaded = self.loaded.count()
        return {"rows_loaded": loaded, "rows_dropped": loaded - kept["rows_kept"], **kept.asDict()}


def run(readings: DataFrame, temp_threshold: float | None = None, battery_threshold: float | None = None,
        validation: str = "enforce", start=None, end=None,
        segment_seconds: int | None = C.DEFAULT_SEGMENT_SECONDS) -> RunResult:
    """The whole run. ``start``/``end`` (inclusive days) filter *before* cleaning, so rows
    outside the range take no part in interpolation. Thresholds: argument beats default."""
    raw = readings
    if start is not None or end is not None:
        raw = date_range_filter(raw, start, end)
    spark = readings.sparkSession
    path = scratch_path(spark, "classified")
    with released():
        cleaned = clean(raw, validation=validation, keep_segment=True, segment_seconds=segment_seconds)
        rows = classify(transform(cleaned, segment_seconds=segment_seconds), temp_threshold, battery_threshold)
        rows.write.parquet(path)
    classified = spark.read.schema(rows.schema).parquet(path)
    return RunResult(classified=classified, anomalies=anomalies(classified),
                     daily=daily_stats(classified, ordered=True), loaded=raw)
