"""Anomaly labels: sustained high temperature (3-row rolling mean) and low battery."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..functions.columns import is_true, nan_to_null
from .timeseries import rolling_mean_3

ANOMALY_REPORT_COLUMNS = [C.TIMESTAMP, C.DEVICE, C.TEMPERATURE, C.BATTERY, C.ANOMALY_TYPE]


def classify(df: DataFrame, temp_threshold: float | None = None,
             battery_threshold: float | None = None) -> DataFrame:
    """Add ``anomaly_type`` and ``is_anomaly`` (never NULL).

    High temperature: rolling mean strictly above the limit; low battery: battery strictly below.
    A missing value never triggers. Without a rolling-mean column it is computed here, per device
    in time order. Thresholds: an argument (0.0 included) beats the default.
    """
    t = C.Thresholds.of(temp_threshold, battery_threshold)
    d = df if C.ROLLING in df.columns else rolling_mean_3(df)
    high = is_true(nan_to_null(C.ROLLING) > F.lit(t.temp_high))
    low = is_true(nan_to_null(C.BATTERY) < F.lit(t.battery_low))
    label = (F.when(high & low, C.LABEL_BOTH).when(low, C.LABEL_LOW_BATTERY)
             .when(high, C.LABEL_HIGH_TEMP).otherwise(C.LABEL_NORMAL))
    cols = [c for c in d.columns if c not in (C.ANOMALY_TYPE, C.IS_ANOMALY)]
    return d.select(*cols, label.alias(C.ANOMALY_TYPE), (high | low).alias(C.IS_ANOMALY))


def anomalies(classified: DataFrame) -> DataFrame:
    """The anomaly report: the five columns of every flagged reading."""
    return classified.filter(F.col(C.IS_ANOMALY)).select(*ANOMALY_REPORT_COLUMNS)


def anomaly_counts(classified: DataFrame) -> DataFrame:
    """Readings per label (map-side combined, so one label holding most rows is no hot spot)."""
    return classified.groupBy(C.ANOMALY_TYPE).agg(F.count(F.lit(1)).alias("readings"))
