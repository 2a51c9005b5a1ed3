"""The star schema the readings are meant for: a device dimension and a reading fact table.

Covers filling both tables (dense device keys, decimal columns), auditing their constraints,
partitioning the fact by year, point-in-time ("as-of") lookups over validity windows, gaps against
each device's expected reporting interval, and a device/time layout that lets Parquet statistics
stand in for the declared indexes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import config as C
from ..functions.columns import epoch_seconds, nan_to_null
from ..session import shared_dir
from .segments import known_neighbours

# --- fixed values: fact column types (decimal precision, scale) ---------------------------------
FACT_DECIMALS = {
    C.TEMPERATURE: (5, 2),
    C.FAHRENHEIT: (5, 2),
    C.HUMIDITY: (5, 2),
    C.PRESSURE: (7, 2),
    "battery_level": (5, 2),
    C.ROLLING: (5, 2),
}
# Reporting classes by expected interval (seconds); a device seen once is 'On-Event'.
HIGH_FREQUENCY_MAX_SECONDS = 60

_ROW_BITS = 33   # monotonically_increasing_id keeps the row number in its lower 33 bits


def decimal_of(c, precision: int, scale: int):
    """Round half away from zero at ``scale`` decimals, as SQL does, and cast; a value that does not fit the declared type
    fails the job, as the table itself would refuse the row."""
    f = float(10 ** scale)
    x = nan_to_null(c)
    rounded = F.signum(x) * F.floor(F.abs(x) * f + 0.5) / f
    fitted = rounded.try_cast(f"decimal({precision},{scale})")
    return F.when(x.isNotNull() & fitted.isNull(), F.raise_error(F.concat(
        F.lit(f"{c} does not fit DECIMAL({precision},{scale}): "), x.cast("string")))).otherwise(fitted)


def dim_devices(readings: DataFrame) -> DataFrame:
    """One row per device with a dense surrogate key in device-id order.

    Devices are range-partitioned and sorted, numbered inside each partition, and shifted by the
    sizes of the partitions before them (a table with one row per partition, so its broadcast is
    bounded by the partition count). The numbered list is checkpointed to the shared folder so the
    keys stay fixed however often the table is read.
    """
    ts_type = readings.schema[C.TIMESTAMP].dataType
    devices = (readings.filter(F.col(C.DEVICE).isNotNull())
               .groupBy(C.DEVICE)
               .agg(F.min(C.TIMESTAMP).alias("created_at"),
                    F.count(C.TIMESTAMP).alias("_n"),
                    (F.max(epoch_seconds(C.TIMESTAMP, ts_type))
                     - F.min(epoch_seconds(C.TIMESTAMP, ts_type))).alias("_span")))
    numbered = (devices.repartitionByRange(C.DEVICE).sortWithinPartitions(C.DEVICE)
                .withColumn("_mid", F.monotonically_increasing_id()))
    shared_dir(numbered.sparkSession)
    numbered = numbered.checkpoint(eager=True)
    numbered = numbered.withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    interval = F.when(F.col("_n") > 1, F.floor(F.col("_span") / (F.col("_n") - 1))).cast("int")
    category = (F.when(interval.isNull(), "On-Event")
                .when(interval <= HIGH_FREQUENCY_MAX_SECONDS, "High-Frequency").otherwise("Periodic"))
    row_in_part = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (numbered.join(F.broadcast(offsets), "_part")
            .select((F.col("_offset") + row_in_part + 1).cast("int").alias("device_key"),
                    F.col(C.DEVICE),
                    F.lit(None).cast("string").alias("model"),
                    F.lit(None).cast("string").alias("location"),
                    F.col("created_at"),
                    interval.alias("expected_interval_seconds"),
                    category.alias("sensor_category")))


def join_dimension(fact: DataFrame, dim: DataFrame, on: str = C.DEVICE) -> DataFrame:
    """Join a dimension to the fact. Rows of a device that the dimension lacks stay, with NULLs. No hint is given: the engine
    broadcasts by measured bytes, and splits a hot device where it shuffles."""
    return fact.join(dim, on, "left")


def fact_sensor_readings(classified: DataFrame, dim: DataFrame) -> DataFrame:
    """The fact table: device key from the dimension (NULL for an unknown device, which the audit counts), battery renamed,
    decimals, validity window."""
    keys = dim.select(C.DEVICE, "device_key")
    f = join_dimension(classified, keys)
    cols = [F.col(C.READING_ID).cast("long").alias("reading_id"),
            F.col("device_key"),
            F.col(C.TIMESTAMP)]
    src = {"battery_level": C.BATTERY}
    for name in (C.TEMPERATURE, C.FAHRENHEIT, C.HUMIDITY, C.PRESSURE, "battery_level"):
        p, s = FACT_DECIMALS[name]
        cols.append(decimal_of(src.get(name, name), p, s).alias(name))
    p, s = FACT_DECIMALS[C.ROLLING]
    cols += [F.col(C.HOUR), decimal_of(C.ROLLING, p, s).alias(C.ROLLING), F.col(C.IS_ANOMALY),
             F.col(C.ANOMALY_TYPE), F.col(C.VALID_UNTIL)]
    return f.select(*cols)


def constraint_audit(dim: DataFrame, fact: DataFrame) -> DataFrame:
    """Violations per declared constraint: unique/non-null device id, non-null key and time,
    and fact rows whose key has no device (a left-anti join)."""
    dup = (dim.groupBy(C.DEVICE).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
           .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("v"))
           .select(F.lit("dim_devices.device_id unique").alias("constraint_name"), F.col("v").alias("violations")))
    dim_nulls = dim.agg(F.count_if(F.col(C.DEVICE).isNull()).alias("v")).select(
        F.lit("dim_devices.device_id not null").alias("constraint_name"), F.col("v").alias("violations"))
    fact_nulls = fact.agg(F.count_if(F.col("device_key").isNull()).alias("k"),
                          F.count_if(F.col(C.TIMESTAMP).isNull()).alias("t"))
    key_null = fact_nulls.select(F.lit("fact_sensor_readings.device_key not null").alias("constraint_name"),
                                 F.col("k").alias("violations"))
    ts_null = fact_nulls.select(F.lit("fact_sensor_readings.timestamp not null").alias("constraint_name"),
                                F.col("t").alias("violations"))
    orphans = orphan_readings(fact, dim).agg(F.count(F.lit(1)).alias("v")).select(
        F.lit("fact_sensor_readings.device_key references dim_devices").alias("constraint_name"),
        F.col("v").alias("violations"))
    return dup.unionByName(dim_nulls).unionByName(key_null).unionByName(ts_null).unionByName(orphans)


def orphan_readings(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Fact rows whose device key is NULL or missing from the dimension."""
    return fact.join(dim.select("device_key"), "device_key", "left_anti")


def with_year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year(C.TIMESTAMP))


def write_fact_by_year(fact: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store the fact partitioned by year (one directory per year), clustered by device and time."""
    out = with_year(fact).repartitionByRange("year", "device_key", C.TIMESTAMP) \
        .sortWithinPartitions("year", "device_key", C.TIMESTAMP)
    out.write.mode(mode).partitionBy("year").parquet(path)


def year_summary(fact_by_year: DataFrame) -> DataFrame:
    return fact_by_year.groupBy("year").agg(F.count(F.lit(1)).alias("readings"),
                                            F.min(C.TIMESTAMP).alias("first_reading"),
                                            F.max(C.TIMESTAMP).alias("last_reading"))


def write_layout(fact: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Device/time layout: range-partitioned by (device_key, timestamp) and sorted in each file, so
    a device or time filter skips row groups by their min/max statistics."""
    (fact.repartitionByRange("device_key", C.TIMESTAMP).sortWithinPartitions("device_key", C.TIMESTAMP)
        .write.mode(mode).parquet(path))


def daily_probes(readings: DataFrame, hour: int = 12) -> DataFrame:
    """Probe times derived from the data: each device, each day from its first to its last reading,
    at ``hour`` o'clock."""
    days = (readings.groupBy(C.DEVICE)
            .agg(F.to_date(F.min(C.TIMESTAMP)).alias("d0"), F.to_date(F.max(C.TIMESTAMP)).alias("d1"))
            .select(C.DEVICE, F.explode(F.sequence("d0", "d1")).alias("d")))
    probe = F.make_timestamp_ntz(F.year("d"), F.month("d"), F.dayofmonth("d"), F.lit(hour), F.lit(0), F.lit(0))
    return days.select(C.DEVICE, probe.alias("probe_ts"))


def asof_reading(readings: DataFrame, probes: DataFrame, cols: list[str] | None = None,
                 segment_seconds: int | None = C.DEFAULT_SEGMENT_SECONDS) -> DataFrame:
    """For each (device, probe_ts): the reading valid then, i.e. the last one at or before the probe
    (``timestamp <= probe_ts < valid_until``); NULLs when the device had not reported yet.

    Probes and readings are merged into one time-ordered stream per device (readings first on equal
    times) and the last reading is carried forward by the segmented scan, so no device's history has
    to fit in one task and no probe is paired with more than one candidate.
    """
    cols = cols or [C.TEMPERATURE, C.HUMIDITY, C.PRESSURE, C.BATTERY]
    ts_type = readings.schema[C.TIMESTAMP].dataType.simpleString()
    rec = F.struct(F.col(C.READING_ID).alias(C.READING_ID), F.col(C.TIMESTAMP).alias("reading_ts"),
                   *[F.col(c).alias(c) for c in cols])
    r = readings.select(C.DEVICE, F.col(C.TIMESTAMP).alias("_t"), F.lit(0).alias("_kind"),
                        F.col(C.READING_ID).alias("_rid"), rec.alias("_rec"))
    p = probes.select(C.DEVICE, F.col("probe_ts").cast(ts_type).alias("_t"), F.lit(1).alias("_kind"),
                      F.lit(None).cast("long").alias("_rid"), F.lit(None).cast(rec_type(r)).alias("_rec"))
    merged = known_neighbours(r.unionByName(p), ["_rec"], key=C.DEVICE, order=["_t", "_kind", "_rid"],
                              seconds=segment_seconds, backward=False)
    return (merged.filter(F.col("_kind") == 1)
            .select(C.DEVICE, F.col("_t").alias("probe_ts"),
                    *[F.col(f"_prev__rec.v.{c}").alias(c) for c in [C.READING_ID, "reading_ts", *cols]]))


def rec_type(df: DataFrame) -> str:
    return df.schema["_rec"].dataType.simpleString()


def reporting_gaps(transformed: DataFrame, dim: DataFrame, factor: float = 2.0) -> DataFrame:
    """Readings followed by a silence longer than ``factor`` × the device's expected interval."""
    ts_type = transformed.schema[C.TIMESTAMP].dataType
    d = join_dimension(transformed.filter(F.col(C.VALID_UNTIL).isNotNull()),
                       dim.select(C.DEVICE, "device_key", "expected_interval_seconds"))
    gap = epoch_seconds(C.VALID_UNTIL, ts_type) - epoch_seconds(C.TIMESTAMP, ts_type)
    return (d.select(C.READING_ID, "device_key", C.DEVICE, C.TIMESTAMP, C.VALID_UNTIL,
                     gap.alias("gap_seconds"), "expected_interval_seconds")
            .filter(F.col("gap_seconds") > F.col("expected_interval_seconds") * F.lit(factor)))


def silences(transformed: DataFrame, dim: DataFrame, factor: float = 2.0) -> DataFrame:
    """As ``reporting_gaps``, with the silence that has not ended: from a device's last reading to the last reading of any device
    (``still_silent``, ``valid_until`` NULL). Devices seen once have no expected interval and no silence."""
    ts_type = transformed.schema[C.TIMESTAMP].dataType
    over = transformed.agg(F.max(epoch_seconds(C.TIMESTAMP, ts_type))).first()[0]
    d = join_dimension(transformed, dim.select(C.DEVICE, "device_key", "expected_interval_seconds"))
    gap = F.coalesce(epoch_seconds(C.VALID_UNTIL, ts_type), F.lit(over)) - epoch_seconds(C.TIMESTAMP, ts_type)
    return (d.select(C.READING_ID, "device_key", C.DEVICE, C.TIMESTAMP, C.VALID_UNTIL, gap.alias("gap_seconds"), "expected_interval_seconds", F.col(C.VALID_UNTIL).isNull().alias("still_silent"))
            .filter(F.col("gap_seconds") > F.col("expected_interval_seconds") * F.lit(factor)))
