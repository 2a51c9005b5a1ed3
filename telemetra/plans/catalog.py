"""Named queries over the shared test tables: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Readings come from the ``events`` table through the fixed rule in ``sources/events.py``. The queries
run in ``report`` validation mode: at the larger scales a few adapted readings break the contract, and
``enforce`` would stop there (``entry`` in ``__spark_entry__`` shows the enforcing run).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config as C
from ..functions.columns import round_floats
from ..operators import anomaly, cleaning, derive, filters, quality, rollups, timeseries
from ..sources import events as ev
from ..sources.readers import coercion_report, parse_readings
from ..session import tune
from . import etl

# Parameters of the queries that take one (fixed values of this catalog).
RANGE_START, RANGE_END = "2024-01-08", "2024-01-14"
ONE_DEVICE = "sensor_0007"
CUSTOM_TEMP, CUSTOM_BATTERY = 25.0, 20.0


def readings(spark: SparkSession, sf: str) -> DataFrame:
    tune(spark)
    return ev.load_readings(spark, sf)


def cleaned(spark, sf, keep_segment=True) -> DataFrame:
    return cleaning.clean(readings(spark, sf), validation="report", keep_segment=keep_segment)


def transformed(spark, sf) -> DataFrame:
    return derive.transform(cleaned(spark, sf))


def classified(spark, sf, temp=None, battery=None) -> DataFrame:
    return anomaly.classify(transformed(spark, sf), temp, battery)


def daily(spark, sf) -> DataFrame:
    """Means are rounded here, for the comparison with another engine; the operators do not round."""
    return round_floats(rollups.daily_stats(classified(spark, sf)))


def q_readings_raw(spark, sf):
    tune(spark)
    return parse_readings(ev.load_text_readings(spark, sf), malformed="raise")


def q_preview(spark, sf):
    return filters.preview(readings(spark, sf), 5)


def q_date_bounds(spark, sf):
    return filters.date_bounds(readings(spark, sf))


def q_date_range_filter(spark, sf):
    return filters.date_range_filter(readings(spark, sf), RANGE_START, RANGE_END)


def one_device(spark, sf):
    """Every step is per device, so selecting the device first gives the same rows; it keeps the
    other devices out of the shuffle (a filter does not cross a persisted frame by itself)."""
    tune(spark)
    r = ev.load_device_readings(spark, sf, ONE_DEVICE)
    return derive.transform(cleaning.clean(r, validation="report", keep_segment=True))


def q_device_readings(spark, sf):
    return anomaly.classify(one_device(spark, sf))


def q_missing_profile(spark, sf):
    return quality.missing_profile(readings(spark, sf), C.READING_COLUMNS)


def q_sorted_readings(spark, sf):
    return timeseries.sort_readings(readings(spark, sf))


def q_coercion_report(spark, sf):
    return coercion_report(ev.load_text_readings(spark, sf))


def q_interpolate_linear(spark, sf):
    return timeseries.interpolate_linear(readings(spark, sf))


def q_drop_incomplete(spark, sf):
    return cleaned(spark, sf, keep_segment=False)


def q_dropped_count(spark, sf):
    return cleaning.dropped_count(readings(spark, sf))


def q_validation_report(spark, sf):
    return quality.validation_report(cleaned(spark, sf, keep_segment=False))


def q_validation_summary(spark, sf):
    return quality.validation_summary(cleaned(spark, sf, keep_segment=False))


def q_fahrenheit(spark, sf):
    return transformed(spark, sf).select(C.READING_ID, C.DEVICE, C.TIMESTAMP, C.TEMPERATURE, C.FAHRENHEIT)


def q_hour_of_day(spark, sf):
    return transformed(spark, sf).select(C.READING_ID, C.TIMESTAMP, C.HOUR)


def q_rolling_avg_3(spark, sf):
    return timeseries.rolling_mean_3(cleaned(spark, sf)) \
        .select(C.READING_ID, C.DEVICE, C.TIMESTAMP, C.TEMPERATURE, C.ROLLING)


def q_valid_until(spark, sf):
    return timeseries.valid_until(cleaned(spark, sf)) \
        .select(C.READING_ID, C.DEVICE, C.TIMESTAMP, C.VALID_UNTIL)


def q_classify_anomalies(spark, sf):
    return classified(spark, sf)


def q_classify_anomalies_custom(spark, sf):
    return classified(spark, sf, CUSTOM_TEMP, CUSTOM_BATTERY)


def q_anomalies(spark, sf):
    return anomaly.anomalies(classified(spark, sf))


def q_anomaly_counts(spark, sf):
    return anomaly.anomaly_counts(classified(spark, sf))


def q_daily_stats(spark, sf):
    return daily(spark, sf)


def q_heatmap_hourly(spark, sf):
    return round_floats(rollups.heatmap_hourly(transformed(spark, sf)))


def q_heatmap_pivot(spark, sf):
    return round_floats(rollups.heatmap_pivot(transformed(spark, sf)))


def q_device_list(spark, sf):
    return rollups.device_list(transformed(spark, sf))


def q_trend_temperature(spark, sf):
    return rollups.trend_temperature(daily(spark, sf))


def q_trend_battery(spark, sf):
    return rollups.trend_battery(daily(spark, sf))


def q_trend_humidity(spark, sf):
    return rollups.trend_humidity(daily(spark, sf))


def q_anomaly_scatter(spark, sf):
    return rollups.anomaly_scatter(classified(spark, sf))


def q_raw_vs_rolling(spark, sf):
    return rollups.raw_vs_rolling(one_device(spark, sf), ONE_DEVICE)


def q_etl_daily(spark, sf):
    return round_floats(etl.run(readings(spark, sf), validation="report").daily)


def q_etl_date_range(spark, sf):
    """The run on a date range: rows outside it take no part in interpolation."""
    return round_floats(etl.run(readings(spark, sf), validation="report", start=RANGE_START, end=RANGE_END).daily)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "readings_raw": q_readings_raw,
    "preview": q_preview,
    "date_bounds": q_date_bounds,
    "date_range_filter": q_date_range_filter,
    "device_readings": q_device_readings,
    "missing_profile": q_missing_profile,
    "sorted_readings": q_sorted_readings,
    "coercion_report": q_coercion_report,
    "interpolate_linear": q_interpolate_linear,
    "drop_incomplete": q_drop_incomplete,
    "dropped_count": q_dropped_count,
    "validation_report": q_validation_report,
    "validation_summary": q_validation_summary,
    "fahrenheit": q_fahrenheit,
    "hour_of_day": q_hour_of_day,
    "rolling_avg_3": q_rolling_avg_3,
    "valid_until": q_valid_until,
    "classify_anomalies": q_classify_anomalies,
    "classify_anomalies_custom": q_classify_anomalies_custom,
    "anomalies": q_anomalies,
    "anomaly_counts": q_anomaly_counts,
    "daily_stats": q_daily_stats,
    "heatmap_hourly": q_heatmap_hourly,
    "heatmap_pivot": q_heatmap_pivot,
    "device_list": q_device_list,
    "trend_temperature": q_trend_temperature,
    "trend_battery": q_trend_battery,
    "trend_humidity": q_trend_humidity,
    "anomaly_scatter": q_anomaly_scatter,
    "raw_vs_rolling": q_raw_vs_rolling,
    "etl_daily": q_etl_daily,
    "etl_date_range": q_etl_date_range,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = dict(QUERIES)
    from . import extra_catalog, history_catalog
    out.update(extra_catalog.QUERIES)
    out.update(history_catalog.QUERIES)
    return out
