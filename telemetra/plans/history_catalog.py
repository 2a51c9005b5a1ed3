"""Queries over stretches of time and over loads, and their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..functions.columns import round_floats
from ..operators import dimension, intervals, levels, payloads, range_frames, reconcile, sketches, top, warehouse as wh
from ..session import scratch_path
from ..sources import events as ev
from ..sources.readers import coercion_report
from ..streaming import jobs, silence
from . import catalog as cat, incremental
from .oracle import BASE, CLASSIFIED_COLS, READINGS, classified_cte, mean, with_ctes

# Fixed values of these queries.
LOAD_CUT = "2024-01-15"          # the first load ends before this day
LATE_DEVICES = 7                 # devices whose number is a multiple of this report from the second load on
MAINTENANCE_MINUTES = 90         # each device, each day, from the hour that is its number modulo 24
OPEN_DEVICES = 10                # devices whose number is a multiple of this are on watch from their first day, without an end
LATE_DAYS = ("2024-01-10", "2024-01-12")      # of these days, devices whose number is a multiple of ...
LATE_EVERY = 5                                # ... this report in a late file
RESENT_EVERY = 6                              # readings whose id is a multiple of this are sent again ...
RESENT_SHIFT = 10**9                          # ... under an id that is larger by this
SILENCE_FACTOR = 2                            # a device is silent after so many of its expected intervals
HOTTEST = 10
# A copy of the readings with defects: ids with this remainder are missing, sent twice, and one degree too warm.
DEFECTS = {"missing": (50, 0), "twice": (70, 1), "warmer": (90, 2)}
# Text that does not parse, by reading id: column, modulus, remainder, text put before the value.
MALFORMED = [(C.TEMPERATURE, 17, 4, "x"), (C.BATTERY, 29, 8, "about "), (C.TIMESTAMP, 101, 9, "day ")]
CUT_PAYLOADS = (23, 6)        # event ids with this remainder have a payload without its last character
DIMS = [C.DEVICE, C.DATE, C.HOUR]


def device_number():
    return F.regexp_extract(C.DEVICE, r"(\d+)$", 1).cast("long")


def q_rolling_6h(spark, sf):
    r = range_frames.rolling_range(cat.readings(spark, sf), window=dt.timedelta(hours=6), name="last_6h")
    return round_floats(r.select(C.READING_ID, C.DEVICE, C.TIMESTAMP, C.TEMPERATURE, "last_6h_count", "last_6h_mean", "last_6h_min", "last_6h_max"))


def q_dim_two_loads(spark, sf):
    """Two loads into one stored dimension; the second one brings later days and new devices, some of which sort before known ones."""
    r = cat.readings(spark, sf)
    first = F.coalesce((F.col(C.TIMESTAMP) < F.lit(LOAD_CUT).cast("timestamp_ntz")) & (device_number() % LATE_DEVICES != 0), F.lit(False))
    table = dimension.VersionedTable(spark, scratch_path(spark, "dim-devices"))
    dimension.load_devices(table, r.filter(first))
    return dimension.load_devices(table, r.filter(~first))


def maintenance_windows(readings: DataFrame) -> DataFrame:
    """(device_id, window_start, window_end): a window a day for each device between its first and last day, and one without an end for some."""
    days = readings.groupBy(C.DEVICE).agg(F.to_date(F.min(C.TIMESTAMP)).alias("d0"), F.to_date(F.max(C.TIMESTAMP)).alias("d1")).filter("d0 IS NOT NULL")
    start = F.col("d").cast("timestamp_ntz") + F.make_dt_interval(hours=(device_number() % 24).cast("int"))
    each = days.select(C.DEVICE, F.explode(F.sequence("d0", "d1")).alias("d")).select(C.DEVICE, start.alias("window_start"))
    daily = each.withColumn("window_end", F.col("window_start") + F.make_dt_interval(mins=F.lit(MAINTENANCE_MINUTES)))
    watch = days.filter(device_number() % OPEN_DEVICES == 0).select(C.DEVICE, F.col("d0").cast("timestamp_ntz").alias("window_start"), F.lit(None).cast("timestamp_ntz").alias("window_end"))
    return daily.unionByName(watch)


def q_maintenance_overlap(spark, sf):
    """Readings whose validity [timestamp, valid_until) reaches into a maintenance window of their device."""
    t = cat.transformed(spark, sf).select(C.READING_ID, C.DEVICE, C.TIMESTAMP, C.VALID_UNTIL)
    met = intervals.interval_join(t, maintenance_windows(cat.readings(spark, sf)), [C.DEVICE], (C.TIMESTAMP, C.VALID_UNTIL), ("window_start", "window_end"))
    return met.select(F.col(f"left.{C.READING_ID}").alias(C.READING_ID), F.col(f"left.{C.DEVICE}").alias(C.DEVICE), F.col("right.window_start").alias("window_start"),
                      F.col("right.window_end").alias("window_end"), "overlap_micros")


def _levels(spark, sf, how):
    r = cat.readings(spark, sf).withColumn(C.DATE, F.to_date(C.TIMESTAMP)).withColumn(C.HOUR, F.hour(C.TIMESTAMP))
    return round_floats(levels.multi_level(r, DIMS, how=how))


def q_rollup_device_time(spark, sf):
    return _levels(spark, sf, "rollup")


def q_cube_device_time(spark, sf):
    return _levels(spark, sf, "cube")


def q_late_day_store(spark, sf):
    """The processed store after a late file: the same rows as a full run gives."""
    r = cat.readings(spark, sf)
    late = F.coalesce(F.to_date(C.TIMESTAMP).isin([dt.date.fromisoformat(d) for d in LATE_DAYS]) & (device_number() % LATE_EVERY == 0), F.lit(False))
    root = scratch_path(spark, "late-store")
    incremental.build(r.filter(~late), root)
    incremental.add_late(spark, root, r.filter(late), "late")
    return incremental.processed(spark, root)


def q_stream_silence(spark, sf):
    """Alarms of devices silent for longer than twice their expected interval, as far as the watermark has come."""
    expected = wh.dim_devices(cat.readings(spark, sf)).select(C.DEVICE, (F.col("expected_interval_seconds").cast("long") * SILENCE_FACTOR).alias("limit_seconds"))
    silence.keyed_state(spark)
    return jobs.run_to_parquet(spark, silence.silence_alarms(jobs.stream_readings(spark, sf), expected), "stream-silence")


def _with_resent(readings: DataFrame) -> DataFrame:
    again = readings.filter(F.col(C.READING_ID) % RESENT_EVERY == 0).withColumn(C.READING_ID, F.col(C.READING_ID) + RESENT_SHIFT)
    return readings.unionByName(again)


def q_distinct_readings(spark, sf):
    return silence.once(_with_resent(cat.readings(spark, sf)))


def q_stream_distinct(spark, sf):
    """Which of two readings sent within the delay comes first is the network's choice, so only what they share is returned."""
    stream = silence.once_on_stream(_with_resent(jobs.stream_readings(spark, sf)))
    return jobs.run_to_parquet(spark, stream.select(C.DEVICE, C.TIMESTAMP), "stream-distinct")


def q_silences(spark, sf):
    """Silences longer than twice the expected interval, the one at the end of each device's history included."""
    t = cat.transformed(spark, sf)
    return wh.silences(t, wh.dim_devices(t))


def q_hottest_readings(spark, sf):
    r = cat.readings(spark, sf).filter(F.col(C.TEMPERATURE).isNotNull()).select(C.DEVICE, C.READING_ID, C.TIMESTAMP, C.TEMPERATURE)
    return top.top_k(r, HOTTEST, [F.col(C.TEMPERATURE).desc(), F.col(C.READING_ID).asc()], C.DEVICE)


def q_reconciliation(spark, sf):
    r = cat.readings(spark, sf)
    hit = {k: F.col(C.READING_ID) % m == n for k, (m, n) in DEFECTS.items()}
    kept = r.filter(~hit["missing"]).withColumn(C.TEMPERATURE, F.when(hit["warmer"], F.col(C.TEMPERATURE) + 1).otherwise(F.col(C.TEMPERATURE)))
    return reconcile.reconciliation(r, kept.unionByName(kept.filter(hit["twice"])), [C.READING_ID])


def q_coercion_malformed(spark, sf):
    """The coercion report of text in which some values do not parse."""
    cat.tune(spark)
    r = ev.load_text_readings(spark, sf)
    for c, m, n, before in MALFORMED:
        r = r.withColumn(c, F.when((F.col(C.READING_ID) % m == n) & (F.col(c) != "null"), F.concat(F.lit(before), c)).otherwise(F.col(c)))
    return coercion_report(r)


def q_monthly_sketches(spark, sf):
    """Months from daily sketches, held against the exact figures: distinct values within 5 % (and one), the median within 3 % of the ranks."""
    r = cat.readings(spark, sf)
    month = F.trunc(C.DATE, "month").alias("month")
    est = sketches.estimates(sketches.merge_sketches(sketches.daily_sketches(r), C.DEVICE, month), {"median": 0.5})
    rows = r.filter(F.col(C.DEVICE).isNotNull() & F.col(C.TIMESTAMP).isNotNull()).select(C.DEVICE, F.trunc(F.to_date(C.TIMESTAMP), "month").alias("month"), F.col(C.TEMPERATURE).alias("v"))
    exact = rows.join(est, [C.DEVICE, "month"]).groupBy(C.DEVICE, "month", "n_values", "n_distinct", "median").agg(
        F.countDistinct("v").alias("d"), F.count_if(F.col("v") < F.col("median")).alias("lo"), F.count_if(F.col("v") <= F.col("median")).alias("hi"))
    n = F.col("n_values")
    return exact.select(C.DEVICE, "month", "n_values", (F.abs(F.col("n_distinct") - F.col("d")) <= 0.05 * F.col("d") + 1).alias("distinct_within"),
                        ((n == 0) | ((F.col("lo") / n - 0.03 <= 0.5) & (F.col("hi") / n + 0.03 >= 0.5))).alias("median_within"))


def q_payload_values(spark, sf):
    """All keys of the events' payloads as typed rows; some payloads are cut and do not parse."""
    cat.tune(spark)
    m, n = CUT_PAYLOADS
    cut = F.when(F.col("event_id") % m == n, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    return payloads.typed_values(spark.read.parquet(ev.events_path(sf)).select("event_id", cut.alias("props")), "props", ["event_id"])


QUERIES = {
    "monthly_sketches": q_monthly_sketches,
    "payload_values": q_payload_values,
    "silences": q_silences,
    "hottest_readings": q_hottest_readings,
    "reconciliation": q_reconciliation,
    "coercion_malformed": q_coercion_malformed,
    "stream_silence": q_stream_silence,
    "distinct_readings": q_distinct_readings,
    "stream_distinct": q_stream_distinct,
    "late_day_store": q_late_day_store,
    "rolling_6h": q_rolling_6h,
    "dim_two_loads": q_dim_two_loads,
    "maintenance_overlap": q_maintenance_overlap,
    "rollup_device_time": q_rollup_device_time,
    "cube_device_time": q_cube_device_time,
}


def oracle_sql() -> dict[str, str]:
    number = "CAST(regexp_extract(device_id, '(\\d+)$', 1) AS BIGINT)"
    seconds = "(epoch_us({}) // 1000000)"
    frame = 'PARTITION BY device_id ORDER BY "timestamp" RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW'
    placed = 'CASE WHEN device_id IS NOT NULL AND "timestamp" IS NOT NULL THEN {} END'
    level = f"""
SELECT device_id, "date", hour_of_day, CAST(grouping_id(device_id, "date", hour_of_day) AS BIGINT) AS grouping_id, count({C.TEMPERATURE}) AS n_values,
       {mean(C.TEMPERATURE)} AS avg_value, round(min({C.TEMPERATURE}), 9) AS min_value, round(max({C.TEMPERATURE}), 9) AS max_value
FROM (SELECT *, CAST("timestamp" AS DATE) AS "date", CAST(hour("timestamp") AS INTEGER) AS hour_of_day FROM readings)
GROUP BY {{}} (device_id, "date", hour_of_day)"""
    first = """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY device_id, "timestamp" ORDER BY reading_id) AS k FROM readings WHERE device_id IS NOT NULL AND "timestamp" IS NOT NULL)"""
    from .extra_oracle import DIM
    wrong = {k: f"reading_id % {m} = {n}" for k, (m, n) in DEFECTS.items()}
    cols = [*C.READING_COLUMNS, C.READING_ID]
    warm = f"CASE WHEN {wrong['warmer']} THEN {C.TEMPERATURE} + 1 ELSE {C.TEMPERATURE} END"
    copy = "SELECT " + ", ".join(f"{warm} AS {C.TEMPERATURE}" if c == C.TEMPERATURE else f'"{c}"' for c in cols) + f" FROM readings WHERE NOT ({wrong['missing']})"
    names = ", ".join(f'"{c}"' for c in cols)
    changed = "".join(f"""
UNION ALL SELECT 'changed', '{c}', count(*) FILTER (l."{c}" IS DISTINCT FROM r."{c}") FROM pairs JOIN less l USING (reading_id) JOIN more r USING (reading_id)""" for c in C.READING_COLUMNS)
    bad = {c: f"(reading_id % {m} = {n})" for c, m, n, _ in MALFORMED}
    return {
        "monthly_sketches": with_ctes(READINGS) + f"""
SELECT device_id, CAST(date_trunc('month', "timestamp") AS DATE) AS month, count({C.TEMPERATURE}) AS n_values, true AS distinct_within, true AS median_within
FROM readings WHERE device_id IS NOT NULL AND "timestamp" IS NOT NULL GROUP BY ALL""",
        "payload_values": f"""
WITH e AS (SELECT event_id, CASE WHEN event_id % {CUT_PAYLOADS[0]} = {CUT_PAYLOADS[1]} THEN substr(props, 1, length(props) - 1) ELSE props END AS p FROM events),
keys AS (SELECT event_id, p, unnest(json_keys(p)) AS key FROM e WHERE json_valid(p))
SELECT event_id, key, CASE json_type(p, '$.' || key) WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' ELSE json_type(p, '$.' || key) END AS value_type,
       json_extract_string(p, '$.' || key) AS value FROM keys
UNION ALL SELECT event_id, NULL, 'MALFORMED', p FROM e WHERE p IS NOT NULL AND NOT json_valid(p)""",
        "silences": with_ctes(*BASE, DIM) + f"""
, ends AS (SELECT max("timestamp") AS over FROM transformed)
SELECT t.reading_id, d.device_key, t.device_id, t."timestamp", t.valid_until,
       {seconds.format('coalesce(t.valid_until, over)')} - {seconds.format('t."timestamp"')} AS gap_seconds, d.expected_interval_seconds, t.valid_until IS NULL AS still_silent
FROM transformed t LEFT JOIN dim d ON t.device_id = d.device_id CROSS JOIN ends
WHERE {seconds.format('coalesce(t.valid_until, over)')} - {seconds.format('t."timestamp"')} > d.expected_interval_seconds * 2.0""",
        "hottest_readings": with_ctes(READINGS) + f"""
SELECT * FROM (SELECT device_id, reading_id, "timestamp", {C.TEMPERATURE}, CAST(row_number() OVER (PARTITION BY device_id ORDER BY {C.TEMPERATURE} DESC, reading_id) AS INTEGER) AS rank
FROM readings WHERE {C.TEMPERATURE} IS NOT NULL) WHERE rank <= {HOTTEST}""",
        "reconciliation": with_ctes(READINGS) + f"""
, copy AS ({copy}), twice AS (SELECT * FROM copy UNION ALL SELECT * FROM copy WHERE {wrong['twice']}),
less AS (SELECT {names} FROM readings EXCEPT ALL SELECT {names} FROM twice), more AS (SELECT {names} FROM twice EXCEPT ALL SELECT {names} FROM readings),
nl AS (SELECT reading_id, count(*) AS n FROM less GROUP BY reading_id), nm AS (SELECT reading_id, count(*) AS n FROM more GROUP BY reading_id),
pairs AS (SELECT reading_id FROM nl JOIN nm USING (reading_id) WHERE nl.n = 1 AND nm.n = 1)
SELECT 'missing' AS finding, CAST(NULL AS VARCHAR) AS column_name, count(*) AS "rows" FROM less WHERE reading_id NOT IN (SELECT reading_id FROM pairs)
UNION ALL SELECT 'extra', NULL, count(*) FROM more WHERE reading_id NOT IN (SELECT reading_id FROM pairs)""" + changed,
        "coercion_malformed": with_ctes(READINGS) + "\n" + " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count("{c}") FILTER (NOT {bad.get(c, 'false')}) AS n_ok, count(*) FILTER ("{c}" IS NULL) AS n_missing,
       count("{c}") FILTER ({bad.get(c, 'false')}) AS n_malformed FROM readings""" for c in C.READING_COLUMNS),
        "distinct_readings": with_ctes(READINGS) + first + f"""
SELECT * EXCLUDE (k) FROM ranked WHERE k = 1
UNION ALL SELECT * FROM readings WHERE device_id IS NULL OR "timestamp" IS NULL
UNION ALL SELECT * REPLACE (reading_id + {RESENT_SHIFT} AS reading_id) FROM readings WHERE (device_id IS NULL OR "timestamp" IS NULL) AND reading_id % {RESENT_EVERY} = 0""",
        "stream_distinct": with_ctes(READINGS) + """
SELECT DISTINCT device_id, "timestamp" FROM readings""",
        "stream_silence": with_ctes(READINGS) + f"""
, limits AS (
  SELECT device_id, greatest(CAST(floor((max({seconds.format('"timestamp"')}) - min({seconds.format('"timestamp"')})) / (count("timestamp") - 1)) AS BIGINT) * {SILENCE_FACTOR}, 1) AS limit_seconds
  FROM readings WHERE device_id IS NOT NULL GROUP BY device_id HAVING count("timestamp") > 1
), r AS (
  SELECT device_id, reading_id, "timestamp", epoch_us("timestamp") AS us, limit_seconds, limit_seconds * 1000000 AS lim
  FROM readings JOIN limits USING (device_id) WHERE "timestamp" IS NOT NULL
), marked AS (SELECT *, (SELECT max(us) // 1000 * 1000 - 86400000000 FROM r) AS mark FROM r),
closed AS (SELECT *, (us // lim + 1) * lim <= mark AS done FROM marked),
seq AS (SELECT *, lead("timestamp") OVER w AS next_at, lead(us) OVER w AS next_us, coalesce(lead(done) OVER w, false) AS next_done FROM closed WINDOW w AS (PARTITION BY device_id ORDER BY us, reading_id))
SELECT device_id, reading_id, "timestamp" AS silent_after, next_at AS until, limit_seconds, 'ended' AS kind FROM seq WHERE next_done AND next_us - us > lim
UNION ALL
SELECT device_id, reading_id, "timestamp", CAST(NULL AS TIMESTAMP), limit_seconds, 'open' FROM seq
WHERE done AND CASE WHEN next_done THEN next_us - us > lim ELSE mark > us + lim AND (next_us IS NULL OR next_us - us > lim) END""",
        "late_day_store": with_ctes(*BASE, classified_cte()) + f"""
SELECT {CLASSIFIED_COLS}, CAST("timestamp" AS DATE) AS "date" FROM classified""",
        "rolling_6h": with_ctes(READINGS) + f"""
SELECT reading_id, device_id, "timestamp", round({C.TEMPERATURE}, 9) AS {C.TEMPERATURE}, {placed.format(f'count({C.TEMPERATURE}) OVER w')} AS last_6h_count,
       {placed.format(f'round(avg({C.TEMPERATURE}) OVER w, 9)')} AS last_6h_mean, {placed.format(f'round(min({C.TEMPERATURE}) OVER w, 9)')} AS last_6h_min,
       {placed.format(f'round(max({C.TEMPERATURE}) OVER w, 9)')} AS last_6h_max
FROM readings WINDOW w AS ({frame})""",
        "dim_two_loads": with_ctes(READINGS) + f"""
, d AS (
  SELECT device_id, min("timestamp") AS created_at, max("timestamp") AS last_seen, count("timestamp") AS n_readings,
         bool_or(coalesce("timestamp" < TIMESTAMP '{LOAD_CUT} 00:00:00' AND {number} % {LATE_DEVICES} <> 0, false)) AS early
  FROM readings WHERE device_id IS NOT NULL GROUP BY device_id
), i AS (
  SELECT *, CASE WHEN n_readings > 1 THEN CAST(floor(({seconds.format('last_seen')} - {seconds.format('created_at')}) / (n_readings - 1)) AS INTEGER) END AS expected_interval_seconds FROM d
)
SELECT CAST(row_number() OVER (ORDER BY early DESC, device_id) AS INTEGER) AS device_key, device_id, CAST(NULL AS VARCHAR) AS model, CAST(NULL AS VARCHAR) AS location,
       created_at, last_seen, n_readings, expected_interval_seconds,
       CASE WHEN expected_interval_seconds IS NULL THEN 'On-Event' WHEN expected_interval_seconds <= 60 THEN 'High-Frequency' ELSE 'Periodic' END AS sensor_category
FROM i""",
        "maintenance_overlap": with_ctes(*BASE) + f"""
, days AS (SELECT device_id, CAST(min("timestamp") AS DATE) AS d0, CAST(max("timestamp") AS DATE) AS d1 FROM readings WHERE device_id IS NOT NULL GROUP BY device_id),
each AS (
  SELECT device_id, CAST(d AS TIMESTAMP) + to_hours({number} % 24) AS window_start FROM (SELECT device_id, unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS d FROM days)
), windows AS (
  SELECT device_id, window_start, window_start + INTERVAL {MAINTENANCE_MINUTES} MINUTE AS window_end FROM each
  UNION ALL SELECT device_id, CAST(d0 AS TIMESTAMP), CAST(NULL AS TIMESTAMP) FROM days WHERE {number} % {OPEN_DEVICES} = 0
)
SELECT t.reading_id, t.device_id, w.window_start, w.window_end,
       epoch_us(CASE WHEN w.window_end IS NULL THEN t.valid_until WHEN t.valid_until IS NULL THEN w.window_end ELSE least(w.window_end, t.valid_until) END)
       - epoch_us(greatest(t."timestamp", w.window_start)) AS overlap_micros
FROM transformed t JOIN windows w ON w.device_id = t.device_id
WHERE (w.window_end IS NULL OR t."timestamp" < w.window_end) AND (t.valid_until IS NULL OR (w.window_start < t.valid_until AND t."timestamp" < t.valid_until))""",
        "rollup_device_time": with_ctes(READINGS) + level.format("ROLLUP"),
        "cube_device_time": with_ctes(READINGS) + level.format("CUBE"),
    }
