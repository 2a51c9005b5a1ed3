"""Aggregates and chart-ready tables: daily stats, hourly heatmap, trends, scatter, raw-vs-rolling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..functions.columns import is_true, mean, nan_to_null

DAILY_COLUMNS = ["device_id", "date", "daily_avg_temp", "daily_avg_humidity", "daily_min_battery"]


def daily_stats(df: DataFrame, ordered: bool = False) -> DataFrame:
    """Per (device, calendar day): mean temperature, mean humidity, minimum battery.

    Rows without a device are left out; means and minimum skip missing values (NaN included). Partial
    aggregation runs before the shuffle, so a device with a huge history is no hot spot.
    ``ordered`` sorts by the keys (for display; costs a range shuffle of the small result).
    """
    out = (df.filter(F.col(C.DEVICE).isNotNull() & F.col(C.TIMESTAMP).isNotNull())
           .groupBy(F.col(C.DEVICE), F.to_date(C.TIMESTAMP).alias(C.DATE))
           .agg(mean(C.TEMPERATURE).alias("daily_avg_temp"),
                mean(C.HUMIDITY).alias("daily_avg_humidity"),
                F.min(nan_to_null(C.BATTERY)).alias("daily_min_battery")))
    return out.orderBy(C.DEVICE, C.DATE) if ordered else out


def heatmap_hourly(df: DataFrame) -> DataFrame:
    """Mean temperature per (device, hour of day), long form."""
    hour = F.col(C.HOUR) if C.HOUR in df.columns else F.hour(C.TIMESTAMP)
    return (df.filter(F.col(C.DEVICE).isNotNull())
            .groupBy(F.col(C.DEVICE), hour.alias(C.HOUR))
            .agg(mean(C.TEMPERATURE).alias("avg_temp")))


def heatmap_pivot(df: DataFrame) -> DataFrame:
    """Device × hour matrix of mean temperature: columns h00 … h23 (NULL where no reading).

    The 24 hour values are given up front, so the pivot needs no extra pass to find them.
    """
    hour = F.col(C.HOUR) if C.HOUR in df.columns else F.hour(C.TIMESTAMP)
    wide = (df.filter(F.col(C.DEVICE).isNotNull()).withColumn("_h", hour)
            .groupBy(C.DEVICE).pivot("_h", list(range(24))).agg(mean(C.TEMPERATURE)))
    return wide.select(C.DEVICE, *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])


def device_list(df: DataFrame) -> DataFrame:
    return df.filter(F.col(C.DEVICE).isNotNull()).select(C.DEVICE).distinct()


def trend_temperature(daily: DataFrame, temp_threshold: float | None = None) -> DataFrame:
    """Daily mean temperature per device with its limit line and a breach flag."""
    limit = C.Thresholds.of(temp_high=temp_threshold).temp_high
    return daily.select(C.DEVICE, C.DATE, "daily_avg_temp", F.lit(limit).alias("temp_limit"),
                        is_true(F.col("daily_avg_temp") > limit).alias("above_limit"))


def trend_battery(daily: DataFrame, battery_threshold: float | None = None) -> DataFrame:
    """Daily minimum battery per device with its limit line and a breach flag."""
    limit = C.Thresholds.of(battery_low=battery_threshold).battery_low
    return daily.select(C.DEVICE, C.DATE, "daily_min_battery", F.lit(limit).alias("battery_limit"),
                        is_true(F.col("daily_min_battery") < limit).alias("below_limit"))


def trend_humidity(daily: DataFrame) -> DataFrame:
    return daily.select(C.DEVICE, C.DATE, "daily_avg_humidity")


def anomaly_scatter(classified: DataFrame, temp_threshold: float | None = None) -> DataFrame:
    """Every reading with its label, for a time × temperature scatter with the limit line."""
    limit = C.Thresholds.of(temp_high=temp_threshold).temp_high
    return classified.select(C.TIMESTAMP, C.TEMPERATURE, C.ANOMALY_TYPE, C.DEVICE, C.BATTERY,
                             C.HUMIDITY, F.lit(limit).alias("temp_limit"))


def raw_vs_rolling(transformed: DataFrame, device: str) -> DataFrame:
    """One device's raw and rolling temperature in long form (variable, value); NULLs kept."""
    one = transformed.filter(F.col(C.DEVICE) == device).select(C.TIMESTAMP, C.DEVICE, C.TEMPERATURE, C.ROLLING)
    return one.unpivot([C.TIMESTAMP, C.DEVICE], [C.TEMPERATURE, C.ROLLING], "variable", "value")
