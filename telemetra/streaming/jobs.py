"""The same rules on a stream of readings (Structured Streaming).

* ``contract_alerts`` — stateless: every reading that breaks the contract or has a low battery.
* ``contract_routed`` — stateless: every reading with the number of rules it breaks, good and bad ones to folders of their own.
* ``daily_stats_stream`` — event-time daily statistics; late rows are dropped once the watermark
  (latest event time minus ``delay``) has passed their day, and a day is emitted when it closes.
* ``rolling_alerts`` — the 3-reading rolling mean in time order whatever the order of arrival: readings wait until the watermark
  passes them, then each micro-batch runs the batch operators' segmented scan behind the last two readings of each device.

Interpolation needs the *next* known value, so repair stays in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import config as C
from ..functions.columns import epoch_seconds, is_true, mean, round_floats
from ..operators.quality import contract_rules
from ..operators.segments import neighbour_rows
from ..session import scratch_path
from ..sources.events import events_path, readings_from_events


def stream_readings(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Readings from the ``events`` files of a folder, as a stream (schema taken from the data)."""
    schema = spark.read.parquet(events_path(sf_dir)).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return readings_from_events(reader.parquet(sf_dir))


def _broken_rules():
    broken = F.lit(0)
    for r in contract_rules():
        broken = broken + F.coalesce(r.failed, F.lit(False)).cast("int")
    return broken


def contract_alerts(readings: DataFrame, battery_threshold: float | None = None) -> DataFrame:
    """Readings with a low battery or at least one broken contract rule (stateless)."""
    limit = C.Thresholds.of(battery_low=battery_threshold).battery_low
    low = is_true(F.col(C.BATTERY) < F.lit(limit))
    return (readings.select(C.READING_ID, C.DEVICE, C.TIMESTAMP, C.BATTERY, low.alias("low_battery"),
                            _broken_rules().alias("contract_failures"))
            .filter(F.col("low_battery") | (F.col("contract_failures") > 0)))


def contract_routed(readings: DataFrame) -> DataFrame:
    """Every reading with the number of contract rules it breaks; ``passes`` is the folder it is routed to."""
    r = readings.withColumn("contract_failures", _broken_rules())
    return r.withColumn("passes", F.col("contract_failures") == 0)


def daily_stats_stream(readings: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily statistics per device on event time, append mode (a day is final once emitted).

    The wall-clock reading time is used as a UTC instant (whole seconds), so days are calendar days
    of the readings whatever the session time zone."""
    event_time = F.timestamp_seconds(epoch_seconds(C.TIMESTAMP, readings.schema[C.TIMESTAMP].dataType))
    r = readings.withColumn("_event_time", event_time).withWatermark("_event_time", delay)
    return (r.groupBy(F.window("_event_time", "1 day").alias("_w"), F.col(C.DEVICE))
            .agg(mean(C.TEMPERATURE).alias("daily_avg_temp"),
                 mean(C.HUMIDITY).alias("daily_avg_humidity"),
                 F.min(C.BATTERY).alias("daily_min_battery"),
                 F.count(F.lit(1)).alias("readings"))
            .select(C.DEVICE, F.date_from_unix_date(F.floor(F.unix_seconds(F.col("_w.start")) / 86400)
                                                    .cast("int")).alias(C.DATE), "daily_avg_temp",
                    "daily_avg_humidity", "daily_min_battery", "readings"))


def _scan(rows: DataFrame) -> DataFrame:
    """Each reading beside its device's two readings before it."""
    return neighbour_rows(rows.withColumn("_r", F.struct(C.TIMESTAMP, C.READING_ID, C.TEMPERATURE)), "_r", lead_col=None)


def _alerts(scanned: DataFrame, limit: float) -> DataFrame:
    """The rolling mean and the high-temperature rule of the readings that were not carried over."""
    rolling = (F.col(f"_lag2.{C.TEMPERATURE}") + F.col(f"_lag1.{C.TEMPERATURE}") + F.col(C.TEMPERATURE)) / C.ROLLING_WINDOW
    return (scanned.filter(~F.col("carried")).select(C.DEVICE, C.READING_ID, C.TIMESTAMP, C.TEMPERATURE, rolling.alias(C.ROLLING))
            .withColumn("high_temperature", is_true(F.col(C.ROLLING) > F.lit(limit))))


def rolling_alerts(readings: DataFrame, work: str, delay: str = "1 day", temp_threshold: float | None = None) -> DataFrame:
    """3-reading rolling mean of temperature per device over all data available now, in time order.

    A reading waits until the latest time seen, less ``delay``, has passed it. The readings so closed go through the batch
    operators' segmented scan behind the last two of their device, so a hot device is spread over tasks and the means are those of the
    batch for any order of arrival within ``delay``. Readings before the mark of an earlier batch, or without a time, go to
    ``late`` and take no part; readings without a temperature are skipped.

    ``work`` holds a folder for each micro-batch, written anew when it is repeated: ``out`` (closed), ``late``, ``rows`` and
    ``state`` (waiting, and the last two of each device). A later call with the same ``work`` goes on from there. Returns the closed
    readings, and with ``closed`` false the waiting ones as they stand now.
    """
    spark = readings.sparkSession
    limit = C.Thresholds.of(temp_high=temp_threshold).temp_high
    r = readings.filter(F.col(C.TEMPERATURE).isNotNull()).select(C.DEVICE, C.TIMESTAMP, C.READING_ID, C.TEMPERATURE)
    state = T.StructType([*r.schema.fields, T.StructField("carried", T.BooleanType())])

    def folder(kind: str, batch: int) -> str:
        return f"{work}/{kind}/batch={batch}"

    def mark(rows: DataFrame):
        at = rows.agg((F.max(C.TIMESTAMP) - F.expr(f"INTERVAL {delay}")).cast("string")).first()[0]
        return F.lit(at).cast(r.schema[C.TIMESTAMP].dataType)

    def step(batch: DataFrame, n: int) -> None:
        read = batch.sparkSession.read.schema(state)
        old = read.parquet(folder("state", n - 1))
        late = is_true(F.col(C.TIMESTAMP) < mark(old)) | F.col(C.TIMESTAMP).isNull()
        batch.filter(late).write.mode("overwrite").parquet(folder("late", n))
        old.unionByName(batch.filter(~late).withColumn("carried", F.lit(False))).write.mode("overwrite").parquet(folder("rows", n))
        rows = read.parquet(folder("rows", n))
        passed = F.col("carried") | is_true(F.col(C.TIMESTAMP) < mark(rows))
        scanned = _scan(rows.filter(passed))
        _alerts(scanned, limit).write.mode("overwrite").parquet(folder("out", n))
        last = (scanned.filter(F.col(C.DEVICE).isNotNull()).groupBy(C.DEVICE).agg(F.max_by(F.array("_r", "_lag1"), "_r").alias("_two"))
                .select(C.DEVICE, F.explode("_two").alias("_r")).filter(F.col("_r").isNotNull()).select(C.DEVICE, "_r.*", F.lit(True).alias("carried")))
        rows.filter(~passed).unionByName(last).write.mode("overwrite").parquet(folder("state", n))

    spark.createDataFrame([], state).write.mode("ignore").parquet(folder("state", -1))
    r.writeStream.foreachBatch(step).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    # once a reading has come, the latest one is in every state
    done = spark.read.schema(state).parquet(f"{work}/state").agg(F.max("batch")).first()[0]
    waiting = _alerts(_scan(spark.read.schema(state).parquet(folder("state", -1 if done is None else done))), limit)
    if done is None:
        return waiting.withColumn("closed", F.lit(False))
    out = spark.read.schema(waiting.schema).parquet(f"{work}/out").drop("batch")
    return out.withColumn("closed", F.lit(True)).unionByName(waiting.withColumn("closed", F.lit(False)))


def late_readings(spark: SparkSession, work: str) -> DataFrame:
    """What ``rolling_alerts`` left out, with the micro-batch in which it came."""
    return spark.read.parquet(f"{work}/late")


def run_to_parquet(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append", partition_by: tuple[str, ...] = (),
                   work: str | None = None) -> DataFrame:
    """Run a stream over all data available now into Parquet under the shared folder (exactly-once) and return what it wrote.
    A later call with the same ``work`` folder goes on from its checkpoint."""
    work = work or scratch_path(spark, name)
    q = (stream.writeStream.format("parquet").option("checkpointLocation", f"{work}/checkpoint").outputMode(mode)
         .partitionBy(*partition_by).trigger(availableNow=True).start(f"{work}/out"))
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{work}/out").select(stream.columns)


def q_stream_alerts(spark, sf):
    return run_to_parquet(spark, contract_alerts(stream_readings(spark, sf)), "stream-alerts")


def q_stream_daily(spark, sf):
    return round_floats(run_to_parquet(spark, daily_stats_stream(stream_readings(spark, sf)), "stream-daily"))


def q_stream_rolling(spark, sf):
    return rolling_alerts(stream_readings(spark, sf), scratch_path(spark, "stream-rolling")).drop("closed")


def q_stream_routed(spark, sf):
    return run_to_parquet(spark, contract_routed(stream_readings(spark, sf)), "stream-routed", partition_by=("passes",))


QUERIES = {
    "stream_alerts": q_stream_alerts,
    "stream_daily": q_stream_daily,
    "stream_rolling": q_stream_rolling,
    "stream_routed": q_stream_routed,
}


def oracle_sql() -> dict[str, str]:
    from ..plans.oracle import READINGS, with_ctes
    fails = ["CASE WHEN \"{}\" IS NULL THEN 1 ELSE 0 END".format(c) for c in C.READING_COLUMNS]
    for c, (lo, hi) in C.CONTRACT_RANGES.items():
        fails.append(f"CASE WHEN {c} < {lo!r} THEN 1 ELSE 0 END")
        fails.append(f"CASE WHEN {c} > {hi!r} THEN 1 ELSE 0 END")
    n_fail = "CAST(" + " + ".join(fails) + " AS INTEGER)"
    low = f"coalesce(battery_level_percent < {C.BATTERY_THRESHOLD_LOW!r}, false)"
    alerts = with_ctes(READINGS) + f"""
SELECT reading_id, device_id, "timestamp", battery_level_percent, {low} AS low_battery,
       {n_fail} AS contract_failures
FROM readings WHERE {low} OR {n_fail} > 0"""
    rolling = with_ctes(READINGS) + f"""
SELECT device_id, reading_id, "timestamp", temperature_celsius, temp_rolling_avg_3,
       coalesce(temp_rolling_avg_3 > {C.TEMP_THRESHOLD_HIGH!r}, false) AS high_temperature
FROM (SELECT *, (lag(temperature_celsius, 2) OVER w + lag(temperature_celsius, 1) OVER w
                 + temperature_celsius) / 3 AS temp_rolling_avg_3
      FROM readings WHERE temperature_celsius IS NOT NULL
      WINDOW w AS (PARTITION BY device_id ORDER BY "timestamp", reading_id))"""
    avg = "round(avg({0}), 9)"
    daily = with_ctes(READINGS) + f"""
SELECT device_id, CAST("timestamp" AS DATE) AS "date", {avg.format('temperature_celsius')} AS daily_avg_temp,
       {avg.format('humidity_percent')} AS daily_avg_humidity, min(battery_level_percent) AS daily_min_battery,
       count(*) AS readings
FROM readings
WHERE CAST("timestamp" AS DATE) + INTERVAL 2 DAY <= (SELECT max("timestamp") FROM readings)
GROUP BY device_id, CAST("timestamp" AS DATE)"""
    routed = with_ctes(READINGS) + f"""
SELECT *, contract_failures = 0 AS passes FROM (SELECT *, {n_fail} AS contract_failures FROM readings)"""
    return {"stream_routed": routed, "stream_alerts": alerts, "stream_rolling": rolling, "stream_daily": daily}
