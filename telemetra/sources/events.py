"""Sensor readings derived from the ``events`` table of the shared test data.

``events`` (event_id, ts, user_id, event_type, value, props) holds no sensor readings, so a fixed rule
turns each event into one reading of a device; gaps are placed by the event id so that every stage
(interpolation, drops, contract failures) has work to do. The same rule is written in SQL in
``plans/oracle.py`` so the results can be checked against another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config as C

# --- fixed values: the event → reading rule -----------------------------------------------------
# device_id   = 'sensor_' + user_id with leading zeros up to 4 digits, never shortened
# temperature = NULL if event_id % 10 = 3, else 15 + value / 10
# humidity    = NULL if event_id % 11 = 5, else props.k as double
# pressure    = NULL if event_id % 13 = 7, else 1000 + event_id % 37
# battery     = NULL if event_id % 97 = 0, else (event_id * 31) % 101


def events_path(sf_dir: str, table: str = "events") -> str:
    return f"{sf_dir.rstrip('/')}/{table}.parquet"


def readings_from_events(events: DataFrame) -> DataFrame:
    """Typed readings, one per event; ``reading_id`` is the event id."""
    eid = F.col("event_id")
    return events.select(
        F.col("ts").alias(C.TIMESTAMP),
        F.when(F.col("user_id").isNotNull(), F.format_string("sensor_%04d", F.col("user_id").cast("long"))).alias(C.DEVICE),
        F.when(eid % 10 != 3, F.lit(15.0) + F.col("value") / 10).alias(C.TEMPERATURE),
        F.when(eid % 11 != 5, F.get_json_object("props", "$.k").try_cast("double")).alias(C.HUMIDITY),
        F.when(eid % 13 != 7, (F.lit(1000) + eid % 37).cast("double")).alias(C.PRESSURE),
        F.when(eid % 97 != 0, ((eid * 31) % 101).cast("double")).alias(C.BATTERY),
        eid.alias(C.READING_ID),
    )


def load_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from_events(spark.read.parquet(events_path(sf_dir)))


def load_device_readings(spark: SparkSession, sf_dir: str, device: str) -> DataFrame:
    """One device's readings: the number in its id is compared in the scan, where row groups are skipped by it."""
    number = device.removeprefix("sensor_")
    events = spark.read.parquet(events_path(sf_dir))
    events = events.filter(F.col("user_id") == int(number)) if number.lstrip("-").isdigit() else events.limit(0)
    return readings_from_events(events).filter(F.col(C.DEVICE) == device)


def readings_as_text(readings: DataFrame, missing_token: str = "null") -> DataFrame:
    """The readings as a text file would carry them: every value as text, gaps as a token."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit(missing_token)).alias(c) for c in C.READING_COLUMNS]
    return readings.select(*cols, C.READING_ID)


def load_text_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_as_text(load_readings(spark, sf_dir))
