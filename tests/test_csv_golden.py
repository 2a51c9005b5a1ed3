"""End to end on the 25-row sample file: the figures of the original run (daily stats, gaps)."""
import os

import pytest
from pyspark.sql import functions as F

from telemetra import anomalies, classify, clean, config as C, daily_stats, missing_profile, transform
from telemetra.sources.readers import coercion_report, read_readings_csv

from conftest import DATA

CSV = os.path.join(DATA, "readings_sample.csv")

DAILY = {  # device: (mean temperature, mean humidity, min battery) on 2023-01-01
    "sensor_001": (22.820, 54.364, 10), "sensor_002": (22.862, 54.554, 65),
    "sensor_003": (22.260, 55.666, 67), "sensor_004": (21.900, 56.420, 80),
    "sensor_005": (21.792, 54.798, 93),
}


@pytest.fixture(scope="module")
def transformed(spark):
    raw = read_readings_csv(spark, CSV)
    return raw, transform(clean(raw))


def test_load_and_missing_profile(spark, transformed):
    raw, _ = transformed
    assert raw.count() == 25
    prof = {r.column_name: r.missing_count for r in missing_profile(raw, [C.TEMPERATURE, C.HUMIDITY]).collect()}
    assert prof == {C.TEMPERATURE: 1, C.HUMIDITY: 1}
    assert raw.schema[C.TIMESTAMP].dataType.simpleString() == "timestamp_ntz"
    assert raw.schema[C.BATTERY].dataType.simpleString() == "double"


def test_gaps_are_repaired(spark, transformed):
    _, t = transformed
    assert t.count() == 25
    get = {(r.device_id, r.timestamp.strftime("%H:%M")): r for r in t.collect()}
    assert get[("sensor_003", "09:43")][C.TEMPERATURE] == pytest.approx(21.84)
    assert get[("sensor_001", "11:30")][C.HUMIDITY] == pytest.approx(54.89)
    s1 = [r[C.ROLLING] for r in t.filter("device_id = 'sensor_001'").orderBy("timestamp").collect()]
    assert s1[:2] == [None, None]
    assert s1[2:] == pytest.approx([26.353333, 23.993333, 19.153333], abs=1e-6)
    assert t.filter(F.col(C.VALID_UNTIL).isNull()).count() == 5


def test_one_anomaly_and_daily_stats(spark, transformed):
    _, t = transformed
    a = anomalies(classify(t)).collect()
    assert [(r.device_id, r.timestamp.strftime("%H:%M"), r.anomaly_type) for r in a] == \
        [("sensor_001", "10:41", C.LABEL_LOW_BATTERY)]
    d = {r.device_id: r for r in daily_stats(t, ordered=True).collect()}
    for dev, (temp, hum, batt) in DAILY.items():
        assert round(d[dev].daily_avg_temp, 3) == temp
        assert round(d[dev].daily_avg_humidity, 3) == hum
        assert d[dev].daily_min_battery == batt
        assert str(d[dev].date) == "2023-01-01"


def test_missing_file(spark):
    with pytest.raises(FileNotFoundError):
        read_readings_csv(spark, "/nonexistent/readings.csv")


def test_malformed_value_is_reported_or_raises(spark, tmp_out):
    p = os.path.join(tmp_out, "bad.csv")
    with open(p, "w") as f:
        f.write("timestamp,device_id,temperature_celsius,humidity_percent,pressure_hpa,battery_level_percent\n")
        f.write("2023-01-01 08:00:00,s,abc,50,1000,90\n2023-01-01 08:10:00,s,NaN,,1000,90\n")
    with pytest.raises(Exception, match="malformed value in column temperature_celsius"):
        read_readings_csv(spark, p).collect()
    rows = read_readings_csv(spark, p, malformed="null").collect()
    assert [r[C.TEMPERATURE] for r in rows] == [None, None]
    raw = spark.read.option("header", True).csv(p)
    rep = {r.column_name: (r.n_ok, r.n_missing, r.n_malformed) for r in coercion_report(raw).collect()}
    assert rep[C.TEMPERATURE] == (0, 1, 1)
    assert rep[C.HUMIDITY] == (1, 1, 0)
