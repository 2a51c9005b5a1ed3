"""The same queries written as plain SQL for DuckDB, over the shared test tables.

Each statement restates one query of ``plans/catalog.py`` without any of the Spark-side machinery
(segments, summaries, persisted frames): plain per-device windows, the way a single-node engine would
write it. Means depend on the order of addition, so both sides round them to nine decimals; every other float is computed
by the same IEEE operations in the same order and compares bit for bit.
"""

from __future__ import annotations

from .. import config as C

# The event → reading rule (see sources/events.py), the cleaning steps and the derived columns,
# as a chain of common table expressions.
READINGS = """
readings AS (
  SELECT ts AS "timestamp",
         printf('sensor_%04d', user_id) AS device_id,
         CASE WHEN event_id % 10 <> 3 THEN CAST(15 AS DOUBLE) + value / 10 END AS temperature_celsius,
         CASE WHEN event_id % 11 <> 5 THEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END
           AS humidity_percent,
         CASE WHEN event_id % 13 <> 7 THEN CAST(1000 + event_id % 37 AS DOUBLE) END AS pressure_hpa,
         CASE WHEN event_id % 97 <> 0 THEN CAST((event_id * 31) % 101 AS DOUBLE) END AS battery_level_percent,
         event_id AS reading_id
  FROM events
)"""


def _neighbours(c: str, p: str) -> str:
    known = f"CASE WHEN {c} IS NOT NULL THEN"
    return (f"last_value({known} {c} END IGNORE NULLS) OVER up AS {p}_pv, "
            f"last_value({known} pos END IGNORE NULLS) OVER up AS {p}_pp, "
            f"first_value({known} {c} END IGNORE NULLS) OVER down AS {p}_nv, "
            f"first_value({known} pos END IGNORE NULLS) OVER down AS {p}_np")


def _interp(c: str, p: str) -> str:
    return (f"CASE WHEN device_id IS NULL THEN NULL WHEN {c} IS NOT NULL THEN {c} "
            f"WHEN {p}_pv IS NOT NULL AND {p}_nv IS NOT NULL "
            f"THEN {p}_pv + (({p}_nv - {p}_pv) / ({p}_np - {p}_pp)) * (pos - {p}_pp) "
            f"ELSE coalesce({p}_pv, {p}_nv) END AS {c}")


INTERPOLATED = f"""
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY device_id
                               ORDER BY "timestamp" ASC NULLS LAST, reading_id ASC NULLS LAST) AS pos
  FROM readings
),
nb AS (
  SELECT *, {_neighbours('temperature_celsius', 't')}, {_neighbours('humidity_percent', 'h')},
         {_neighbours('pressure_hpa', 'p')}
  FROM ordered
  WINDOW up AS (PARTITION BY device_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS (PARTITION BY device_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
interpolated AS (
  SELECT "timestamp", device_id, {_interp('temperature_celsius', 't')}, {_interp('humidity_percent', 'h')},
         {_interp('pressure_hpa', 'p')}, battery_level_percent, reading_id
  FROM nb
)"""

CLEANED = """
cleaned AS (
  SELECT * FROM interpolated
  WHERE "timestamp" IS NOT NULL AND device_id IS NOT NULL AND temperature_celsius IS NOT NULL
    AND humidity_percent IS NOT NULL AND pressure_hpa IS NOT NULL AND battery_level_percent IS NOT NULL
    AND reading_id IS NOT NULL
)"""

TRANSFORMED = """
transformed AS (
  SELECT *, temperature_celsius * 9 / 5 + 32 AS temperature_fahrenheit,
         CAST(hour("timestamp") AS INTEGER) AS hour_of_day,
         (lag(temperature_celsius, 2) OVER w + lag(temperature_celsius, 1) OVER w + temperature_celsius) / 3
           AS temp_rolling_avg_3,
         lead("timestamp", 1) OVER w AS valid_until
  FROM cleaned
  WINDOW w AS (PARTITION BY device_id ORDER BY "timestamp", reading_id)
)"""


def classified_cte(temp: float = C.TEMP_THRESHOLD_HIGH, battery: float = C.BATTERY_THRESHOLD_LOW) -> str:
    return f"""
flags AS (
  SELECT *, coalesce(temp_rolling_avg_3 > {temp!r}, false) AS _hi,
            coalesce(battery_level_percent < {battery!r}, false) AS _lo
  FROM transformed
),
classified AS (
  SELECT "timestamp", device_id, temperature_celsius, humidity_percent, pressure_hpa, battery_level_percent,
         reading_id, temperature_fahrenheit, hour_of_day, temp_rolling_avg_3, valid_until,
         CASE WHEN _hi AND _lo THEN '{C.LABEL_BOTH}' WHEN _lo THEN '{C.LABEL_LOW_BATTERY}'
              WHEN _hi THEN '{C.LABEL_HIGH_TEMP}' ELSE '{C.LABEL_NORMAL}' END AS anomaly_type,
         (_hi OR _lo) AS is_anomaly
  FROM flags
)"""


def mean(x: str) -> str:
    """DuckDB's own mean, compared after rounding to nine decimals (at six, short means fall on ties that two engines round apart)."""
    return f"round(avg({x}), 9)"


DAILY = f"""
daily AS (
  SELECT device_id, CAST("timestamp" AS DATE) AS "date",
         {mean('temperature_celsius')} AS daily_avg_temp, {mean('humidity_percent')} AS daily_avg_humidity,
         min(battery_level_percent) AS daily_min_battery
  FROM classified WHERE device_id IS NOT NULL
  GROUP BY device_id, CAST("timestamp" AS DATE)
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


BASE = (READINGS, INTERPOLATED, CLEANED, TRANSFORMED)


READING_COLS = ('"timestamp", device_id, temperature_celsius, '
                'humidity_percent, pressure_hpa, '
                'battery_level_percent, reading_id')

CLASSIFIED_COLS = (READING_COLS + ", temperature_fahrenheit, hour_of_day, "
                   "temp_rolling_avg_3 AS temp_rolling_avg_3, valid_until, anomaly_type, is_anomaly")


def _q(ctes, select: str) -> str:
    return with_ctes(*ctes) + "\n" + select


def _base(*extra):
    return (*BASE, *extra)


RS, RE = "2024-01-08", "2024-01-14"
DEV = "sensor_0007"
DAILY_ROUND = ("device_id, \"date\", daily_avg_temp, "
               "daily_avg_humidity, "
               "daily_min_battery")


def _etl_date_range() -> str:
    filtered = READINGS.replace("FROM events\n)", f"FROM events\n  WHERE ts >= TIMESTAMP '{RS} 00:00:00' "
                                                 f"AND ts < TIMESTAMP '{RE} 00:00:00' + INTERVAL 1 DAY\n)")
    return _q((filtered, INTERPOLATED, CLEANED, TRANSFORMED, classified_cte(), DAILY),
              f"SELECT {DAILY_ROUND} FROM daily")


def _missing_profile() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count(\"{c}\") AS missing_count FROM readings"
        for c in C.READING_COLUMNS)
    return _q((READINGS,), parts)


def _coercion_report() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(\"{c}\") AS n_ok, count(*) - count(\"{c}\") AS n_missing, "
        f"CAST(0 AS BIGINT) AS n_malformed FROM readings" for c in C.READING_COLUMNS)
    return _q((READINGS,), parts)


def _validation_rules() -> str:
    rows = [f"SELECT reading_id, device_id, \"timestamp\", '{c}' AS column_name, 'not_nullable' AS \"check\", "
            f"CAST(NULL AS DOUBLE) AS failure_value FROM cleaned WHERE \"{c}\" IS NULL" for c in C.READING_COLUMNS]
    for c, (lo, hi) in C.CONTRACT_RANGES.items():
        rows.append(f"SELECT reading_id, device_id, \"timestamp\", '{c}', 'greater_than_or_equal_to({lo:g})', "
                    f"{c} FROM cleaned WHERE {c} < {lo!r}")
        rows.append(f"SELECT reading_id, device_id, \"timestamp\", '{c}', 'less_than_or_equal_to({hi:g})', "
                    f"{c} FROM cleaned WHERE {c} > {hi!r}")
    return "\nUNION ALL\n".join(rows)


def _heatmap_pivot() -> str:
    cols = ", ".join(f"{mean(f'CASE WHEN hour_of_day = {h} THEN temperature_celsius END')} AS h{h:02d}"
                     for h in range(24))
    return _q(_base(), f"SELECT device_id, {cols} FROM transformed GROUP BY device_id")


def oracle_sql() -> dict[str, str]:
    cls = classified_cte()
    out = {
        "readings_raw": _q((READINGS,), f"SELECT {READING_COLS} FROM readings"),
        "preview": _q((READINGS,), f"SELECT {READING_COLS} FROM readings ORDER BY reading_id LIMIT 5"),
        "date_bounds": _q((READINGS,), 'SELECT CAST(min("timestamp") AS DATE) AS min_date, '
                                       'CAST(max("timestamp") AS DATE) AS max_date FROM readings'),
        "date_range_filter": _q((READINGS,), f"SELECT {READING_COLS} FROM readings "
                                             f"WHERE \"timestamp\" >= TIMESTAMP '{RS} 00:00:00' "
                                             f"AND \"timestamp\" < TIMESTAMP '{RE} 00:00:00' + INTERVAL 1 DAY"),
        "device_readings": _q(_base(cls), f"SELECT {CLASSIFIED_COLS} FROM classified WHERE device_id = '{DEV}'"),
        "missing_profile": _missing_profile(),
        "sorted_readings": _q((READINGS,), f"SELECT {READING_COLS} FROM readings "
                                           "ORDER BY device_id, \"timestamp\", reading_id"),
        "coercion_report": _coercion_report(),
        "interpolate_linear": _q((READINGS, INTERPOLATED), f"SELECT {READING_COLS} FROM interpolated"),
        "drop_incomplete": _q((READINGS, INTERPOLATED, CLEANED), f"SELECT {READING_COLS} FROM cleaned"),
        "dropped_count": _q((READINGS, INTERPOLATED),
                            "SELECT count(*) AS rows_loaded, count(*) FILTER (WHERE \"timestamp\" IS NOT NULL "
                            "AND device_id IS NOT NULL AND temperature_celsius IS NOT NULL AND humidity_percent "
                            "IS NOT NULL AND pressure_hpa IS NOT NULL AND battery_level_percent IS NOT NULL AND "
                            "reading_id IS NOT NULL) AS rows_kept, count(*) - rows_kept AS rows_dropped "
                            "FROM interpolated"),
        "validation_report": _q((READINGS, INTERPOLATED, CLEANED), _validation_rules()),
        "validation_summary": _q((READINGS, INTERPOLATED, CLEANED),
                                 f"SELECT column_name, \"check\", count(*) AS failure_count FROM "
                                 f"({_validation_rules()}) GROUP BY column_name, \"check\""),
        "fahrenheit": _q(_base(), "SELECT reading_id, device_id, \"timestamp\", temperature_celsius AS "
                                  "temperature_celsius, temperature_fahrenheit "
                                  "FROM transformed"),
        "hour_of_day": _q(_base(), "SELECT reading_id, \"timestamp\", hour_of_day FROM transformed"),
        "rolling_avg_3": _q(_base(), "SELECT reading_id, device_id, \"timestamp\", temperature_celsius "
                                     "AS temperature_celsius, temp_rolling_avg_3 AS temp_rolling_avg_3 "
                                     "FROM transformed"),
        "valid_until": _q(_base(), "SELECT reading_id, device_id, \"timestamp\", valid_until FROM transformed"),
        "classify_anomalies": _q(_base(cls), f"SELECT {CLASSIFIED_COLS} FROM classified"),
        "classify_anomalies_custom": _q(_base(classified_cte(25.0, 20.0)),
                                        f"SELECT {CLASSIFIED_COLS} FROM classified"),
        "anomalies": _q(_base(cls), "SELECT \"timestamp\", device_id, temperature_celsius AS "
                                    "temperature_celsius, battery_level_percent, "
                                    "anomaly_type FROM classified WHERE is_anomaly"),
        "anomaly_counts": _q(_base(cls), "SELECT anomaly_type, count(*) AS readings FROM classified "
                                         "GROUP BY anomaly_type"),
        "daily_stats": _q(_base(cls, DAILY), f"SELECT {DAILY_ROUND} FROM daily"),
        "heatmap_hourly": _q(_base(), f"SELECT device_id, hour_of_day, {mean('temperature_celsius')} AS avg_temp "
                                      "FROM transformed GROUP BY device_id, hour_of_day"),
        "heatmap_pivot": _heatmap_pivot(),
        "device_list": _q(_base(), "SELECT DISTINCT device_id FROM transformed"),
        "trend_temperature": _q(_base(cls, DAILY),
                                "SELECT device_id, \"date\", daily_avg_temp, "
                                f"CAST({C.TEMP_THRESHOLD_HIGH!r} AS DOUBLE) AS temp_limit, coalesce(daily_avg_temp > "
                                f"{C.TEMP_THRESHOLD_HIGH!r}, false) AS above_limit FROM daily"),
        "trend_battery": _q(_base(cls, DAILY),
                            "SELECT device_id, \"date\", daily_min_battery, "
                            f"CAST({C.BATTERY_THRESHOLD_LOW!r} AS DOUBLE) AS battery_limit, coalesce(daily_min_battery < "
                            f"{C.BATTERY_THRESHOLD_LOW!r}, false) AS below_limit FROM daily"),
        "trend_humidity": _q(_base(cls, DAILY), "SELECT device_id, \"date\", daily_avg_humidity AS "
                                                "daily_avg_humidity FROM daily"),
        "anomaly_scatter": _q(_base(cls), "SELECT \"timestamp\", temperature_celsius, "
                                          "anomaly_type, device_id, battery_level_percent AS "
                                          "battery_level_percent, humidity_percent, "
                                          f"CAST({C.TEMP_THRESHOLD_HIGH!r} AS DOUBLE) AS temp_limit FROM classified"),
        "raw_vs_rolling": _q(_base(), "SELECT \"timestamp\", device_id, variable, value FROM ("
                                      "SELECT \"timestamp\", device_id, 'temperature_celsius' AS variable, "
                                      "temperature_celsius AS value FROM transformed WHERE device_id = "
                                      f"'{DEV}' UNION ALL SELECT \"timestamp\", device_id, 'temp_rolling_avg_3', "
                                      f"temp_rolling_avg_3 FROM transformed WHERE device_id = '{DEV}')"),
        "etl_daily": _q(_base(cls, DAILY), f"SELECT {DAILY_ROUND} FROM daily ORDER BY device_id, \"date\""),
        "etl_date_range": _etl_date_range(),
    }
    from .extra_oracle import oracle_sql as extra
    from .history_catalog import oracle_sql as history
    out.update(extra())
    out.update(history())
    return out
