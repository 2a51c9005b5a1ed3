"""SQL oracles for the sinks, warehouse and streaming queries."""

from __future__ import annotations

from .. import config as C
from .oracle import BASE, CLASSIFIED_COLS, READING_COLS, classified_cte, with_ctes

EPOCH_S = "(epoch_us({}) // 1000000)"

DIM = f"""
dim AS (
  SELECT CAST(row_number() OVER (ORDER BY device_id) AS INTEGER) AS device_key, device_id,
         CAST(NULL AS VARCHAR) AS model, CAST(NULL AS VARCHAR) AS location, created_at,
         expected_interval_seconds,
         CASE WHEN expected_interval_seconds IS NULL THEN 'On-Event'
              WHEN expected_interval_seconds <= 60 THEN 'High-Frequency' ELSE 'Periodic' END AS sensor_category
  FROM (SELECT device_id, min("timestamp") AS created_at,
               CASE WHEN count("timestamp") > 1 THEN CAST(floor(
                 (max({EPOCH_S.format('"timestamp"')}) - min({EPOCH_S.format('"timestamp"')}))
                 / (count("timestamp") - 1)) AS INTEGER) END AS expected_interval_seconds
        FROM transformed WHERE device_id IS NOT NULL GROUP BY device_id)
)"""


def dec(c: str, p: int, s: int, alias: str) -> str:
    return f"CAST({c} AS DECIMAL({p},{s})) AS {alias}"


FACT = f"""
fact AS (
  SELECT c.reading_id, d.device_key, c."timestamp",
         {dec('c.temperature_celsius', 5, 2, 'temperature_celsius')},
         {dec('c.temperature_fahrenheit', 5, 2, 'temperature_fahrenheit')},
         {dec('c.humidity_percent', 5, 2, 'humidity_percent')},
         {dec('c.pressure_hpa', 7, 2, 'pressure_hpa')},
         {dec('c.battery_level_percent', 5, 2, 'battery_level')},
         c.hour_of_day, {dec('c.temp_rolling_avg_3', 5, 2, 'temp_rolling_avg_3')},
         c.is_anomaly, c.anomaly_type, c.valid_until
  FROM classified c LEFT JOIN dim d ON c.device_id = d.device_id
)"""

# The dimension with the fixed defects of ``extra_catalog.defective``, and the fact on it.
LACKING = """
lacking AS (SELECT * FROM dim WHERE device_key % 10 <> 3),
doubled AS (SELECT * FROM lacking UNION ALL SELECT * FROM lacking WHERE device_key % 10 = 5)"""
FACT_LACKING = FACT.replace("LEFT JOIN dim d", "LEFT JOIN lacking d")

FACT_COLS = ('reading_id, device_key, "timestamp", temperature_celsius, temperature_fahrenheit, humidity_percent, '
             'pressure_hpa, battery_level, hour_of_day, temp_rolling_avg_3, is_anomaly, anomaly_type, valid_until')


def _q(ctes, select):
    return with_ctes(*ctes) + "\n" + select


def oracle_sql() -> dict[str, str]:
    cls = classified_cte()
    wh = (*BASE, cls, DIM, FACT)
    bad = (*BASE, cls, DIM, LACKING, FACT_LACKING)
    out = {
        "roundtrip_csv": _q((*BASE, cls), f'SELECT {READING_COLS}, CAST("timestamp" AS DATE) AS "date" FROM classified'),
        "export_csv": _q((*BASE, cls), f"SELECT {READING_COLS}, anomaly_type, is_anomaly FROM classified"),
        "roundtrip_parquet": _q((*BASE, cls), f'SELECT {CLASSIFIED_COLS}, CAST("timestamp" AS DATE) AS "date" '
                                              "FROM classified"),
        "dim_devices": _q((*BASE, DIM), "SELECT * FROM dim"),
        "fact_sensor_readings": _q(wh, f"SELECT {FACT_COLS} FROM fact"),
        "fact_layout": _q(wh, f"SELECT {FACT_COLS} FROM fact"),
        "constraint_audit": _q(bad, """
SELECT 'dim_devices.device_id unique' AS constraint_name,
       CAST(coalesce((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM doubled GROUP BY device_id) WHERE n > 1), 0)
            AS BIGINT) AS violations
UNION ALL SELECT 'dim_devices.device_id not null', count(*) FILTER (WHERE device_id IS NULL) FROM doubled
UNION ALL SELECT 'fact_sensor_readings.device_key not null', count(*) FILTER (WHERE device_key IS NULL) FROM fact
UNION ALL SELECT 'fact_sensor_readings.timestamp not null', count(*) FILTER (WHERE "timestamp" IS NULL) FROM fact
UNION ALL SELECT 'fact_sensor_readings.device_key references dim_devices',
       count(*) FROM fact WHERE NOT EXISTS (SELECT 1 FROM doubled WHERE doubled.device_key = fact.device_key)"""),
        "orphan_readings": _q(bad, f"SELECT {FACT_COLS} FROM fact WHERE NOT EXISTS "
                                   "(SELECT 1 FROM doubled WHERE doubled.device_key = fact.device_key)"),
        "fact_by_year": _q(wh, 'SELECT CAST(year("timestamp") AS INTEGER) AS "year", count(*) AS readings, '
                               'min("timestamp") AS first_reading, max("timestamp") AS last_reading '
                               'FROM fact GROUP BY year("timestamp")'),
        "asof_reading": _q(BASE, f"""
SELECT p.device_id, p.probe_ts, r.reading_id, r."timestamp" AS reading_ts, r.{C.TEMPERATURE}, r.{C.HUMIDITY},
       r.{C.PRESSURE}, r.{C.BATTERY}
FROM (SELECT device_id, CAST(d AS TIMESTAMP) + INTERVAL 12 HOUR AS probe_ts
      FROM (SELECT device_id, unnest(generate_series(CAST(min("timestamp") AS DATE), CAST(max("timestamp") AS DATE),
                                                     INTERVAL 1 DAY)) AS d
            FROM transformed GROUP BY device_id)) p
LEFT JOIN transformed r ON r.device_id = p.device_id AND r."timestamp" <= p.probe_ts
     AND (r.valid_until IS NULL OR p.probe_ts < r.valid_until)"""),
        "reporting_gaps": _q((*BASE, DIM), f"""
SELECT t.reading_id, d.device_key, t.device_id, t."timestamp", t.valid_until,
       {EPOCH_S.format('t.valid_until')} - {EPOCH_S.format('t."timestamp"')} AS gap_seconds,
       d.expected_interval_seconds
FROM transformed t LEFT JOIN dim d ON t.device_id = d.device_id
WHERE t.valid_until IS NOT NULL
  AND {EPOCH_S.format('t.valid_until')} - {EPOCH_S.format('t."timestamp"')} > d.expected_interval_seconds * 2.0"""),
    }
    from ..streaming.jobs import oracle_sql as stream_sql
    out.update(stream_sql())
    return out
