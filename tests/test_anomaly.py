"""Anomaly labels (the reference's anomaly case, with exact counts) and thresholds."""
import datetime as dt

from telemetra import anomalies, classify, config as C

SCHEMA = "timestamp timestamp_ntz, device_id string, temperature_celsius double, battery_level_percent double"


def f2(spark):
    t = dt.datetime(2023, 1, 1, 10, 0)
    rows = [(t, "s1", 35.0, 90.0), (t + dt.timedelta(minutes=10), "s1", 35.0, 90.0),
            (t + dt.timedelta(minutes=20), "s1", 35.0, 90.0), (t, "s2", 20.0, 10.0)]
    return spark.createDataFrame(rows, SCHEMA)


def labels(df):
    return {(r.device_id, r.timestamp.minute): r.anomaly_type for r in df.collect()}


def test_rolling_window_must_be_full_and_exactly_two_anomalies(spark):
    out = classify(f2(spark))
    got = labels(out)
    assert got[("s1", 0)] == C.LABEL_NORMAL and got[("s1", 10)] == C.LABEL_NORMAL
    assert got[("s1", 20)] == C.LABEL_HIGH_TEMP
    assert got[("s2", 0)] == C.LABEL_LOW_BATTERY
    assert anomalies(out).count() == 2
    assert anomalies(out).columns == [C.TIMESTAMP, C.DEVICE, C.TEMPERATURE, C.BATTERY, C.ANOMALY_TYPE]


def test_combined_label_and_explicit_zero_threshold(spark):
    t = dt.datetime(2023, 1, 1)
    rows = [(t + dt.timedelta(minutes=i), "s", 40.0, 5.0) for i in range(3)]
    out = labels(classify(spark.createDataFrame(rows, SCHEMA)))
    assert out[("s", 2)] == C.LABEL_BOTH
    # 0.0 is a real threshold (no battery is below 0), not "use the default"
    zero = classify(spark.createDataFrame(rows, SCHEMA), battery_threshold=0.0)
    assert labels(zero)[("s", 2)] == C.LABEL_HIGH_TEMP


def test_strict_comparisons_and_missing_values(spark):
    t = dt.datetime(2023, 1, 1)
    rows = [(t + dt.timedelta(minutes=i), "s", 30.0, None if i == 1 else 15.0) for i in range(3)]
    out = classify(spark.createDataFrame(rows, SCHEMA))
    assert all(r.anomaly_type == C.LABEL_NORMAL and r.is_anomaly is False for r in out.collect())


def test_existing_rolling_column_is_used(spark):
    t = dt.datetime(2023, 1, 1)
    df = spark.createDataFrame([(t, "s", 0.0, 90.0, 99.0)], SCHEMA + ", temp_rolling_avg_3 double")
    assert classify(df).first().anomaly_type == C.LABEL_HIGH_TEMP
