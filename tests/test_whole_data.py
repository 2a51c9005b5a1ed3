"""Nothing is cut, merged, nulled or dropped in silence."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from telemetra import classify, clean, config as C, transform
from telemetra.functions.columns import mean
from telemetra.operators import segments, warehouse as wh
from telemetra.operators.quality import missing_profile, validation_report
from telemetra.operators.timeseries import interpolate_linear
from telemetra.sources.events import load_readings, readings_from_events
from telemetra.sources.readers import parse_readings, read_readings_csv, read_readings_parquet

from conftest import SF_SMALL
from test_cleaning import model_interpolate

SCHEMA = ("timestamp timestamp_ntz, device_id string, temperature_celsius double, humidity_percent double, "
          "pressure_hpa double, battery_level_percent double, reading_id long")
T0 = dt.datetime(2024, 1, 1)


def test_long_device_ids_stay_apart(spark):
    rows = [(i, T0, u, "x", 1.0, '{"k": 1}') for i, u in enumerate([7, 9999, 10000, 12340, 12341, 123456, None])]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    got = [r.device_id for r in readings_from_events(ev).orderBy(C.READING_ID).collect()]
    assert got == ["sensor_0007", "sensor_9999", "sensor_10000", "sensor_12340", "sensor_12341", "sensor_123456", None]


def test_a_stray_time_and_missing_times_do_not_gather_a_device(spark, monkeypatch):
    monkeypatch.setattr(C, "TARGET_SEGMENT_ROWS", 25)
    rows, values = [], []
    for i in range(600):
        v = None if i % 7 == 3 else float(i % 17)
        values.append(v)
        rows.append((T0 + dt.timedelta(seconds=10 * i), "hot", v, 1.0, 1.0, 1.0, i + 1))
    rows.insert(0, (dt.datetime(1970, 1, 1), "hot", 5.0, 1.0, 1.0, 1.0, 0))
    rows += [(None, "late", 1.0, 1.0, 1.0, 1.0, 1000 + i) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = segments.add_segment(df, seconds=None).groupBy("device_id", segments.SEG).count()
    assert sizes.agg(F.max("count")).first()[0] <= 50
    got = [r[C.TEMPERATURE] for r in interpolate_linear(df, segment_seconds=None).filter("device_id = 'hot'").orderBy("timestamp").collect()]
    assert got == model_interpolate([5.0] + values)


def test_unknown_devices_stay_and_are_counted(spark):
    c = classify(transform(clean(load_readings(spark, SF_SMALL), validation="report")))
    dim = wh.dim_devices(c)
    lacking = dim.filter("device_key % 5 <> 0")
    fact = wh.fact_sensor_readings(c, lacking)
    assert fact.count() == c.count()
    missing = c.join(lacking, C.DEVICE, "left_anti").count()
    found = {r.constraint_name: r.violations for r in wh.constraint_audit(lacking.unionByName(lacking.limit(2)), fact).collect()}
    assert missing > 0 and found["fact_sensor_readings.device_key not null"] == missing
    assert found["fact_sensor_readings.device_key references dim_devices"] == missing == wh.orphan_readings(fact, lacking).count()
    assert found["dim_devices.device_id unique"] == 2


def test_decimals_round_like_sql_and_do_not_vanish(spark):
    d = spark.createDataFrame([(-0.125,), (0.125,), (999.99,), (float("nan"),), (None,)], "x double")
    assert [None if v is None else str(v) for v, in d.select(wh.decimal_of("x", 5, 2)).collect()] == ["-0.13", "0.13", "999.99", None, None]
    for x in (1000.0, 999.996):
        with pytest.raises(Exception, match="does not fit"):
            spark.createDataFrame([(x,)], "x double").select(wh.decimal_of("x", 5, 2)).collect()


def test_mean_skips_missing_and_nothing_else(spark):
    avg = lambda v: spark.createDataFrame([(x,) for x in v], "x double").agg(mean("x")).first()[0]
    assert avg([20.0, float("nan"), 20.0, None]) == 20.0
    assert avg([4e-10, 4e-10]) == 4e-10
    assert avg([float("inf"), 1.0]) == float("inf")


def test_nan_is_missing_in_parquet_and_in_rules(spark, tmp_out):
    nan = float("nan")
    df = spark.createDataFrame([(T0, "a", nan, 1.0, nan, 1.0, 1), (T0, "a", 1.0, 1.0, 1.0, 1.0, 2)], SCHEMA)
    assert {r.column_name: r.missing_count for r in missing_profile(df).collect()}[C.TEMPERATURE] == 1
    assert [r.check for r in validation_report(df).collect()] == ["not_nullable", "not_nullable"]
    df.write.parquet(tmp_out + "/p")
    assert read_readings_parquet(spark, tmp_out + "/p").filter(F.col(C.TEMPERATURE).isNull()).count() == 1
    flagged = classify(df.withColumn(C.ROLLING, F.lit(nan)).withColumn(C.BATTERY, F.lit(nan)))
    assert {r[C.ANOMALY_TYPE] for r in flagged.collect()} == {C.LABEL_NORMAL}


def test_bad_text_fails(spark, tmp_out):
    text = spark.createDataFrame([("2024-01-01 00:00:00", "a", 1.0, 1.0, 1.0, 1.0, 1), ("soon", "a", 1.0, 1.0, 1.0, 1.0, 2)],
                                 SCHEMA.replace("timestamp timestamp_ntz", "timestamp string"))
    with pytest.raises(Exception, match="unparsable timestamp"):
        clean(text, validation="report").collect()
    with pytest.raises(Exception, match="malformed value"):
        parse_readings(spark.createDataFrame([(T0, "a", "warm", 1.0)], "timestamp timestamp_ntz, device_id string, temperature_celsius string, humidity_percent double")).collect()
    path = os.path.join(tmp_out, "r.csv")
    with open(path, "w") as f:
        f.write("timestamp,device_id,temperature_celsius,humidity_percent\n2024-01-01 00:00:00,a,1,2\n2024-01-01 00:00:01,a,1,2,3,4\n")
    with pytest.raises(Exception, match="number of fields"):
        read_readings_csv(spark, path).collect()
