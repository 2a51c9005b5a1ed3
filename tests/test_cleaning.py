"""Gap repair, dropping and the contract (the reference's cleaning cases plus edge cases)."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from telemetra import ContractViolation, clean, config as C
from telemetra.operators.timeseries import interpolate_linear

SCHEMA = ("timestamp string, device_id string, temperature_celsius double, humidity_percent double, "
          "pressure_hpa double, battery_level_percent long")


def f1(spark, first_temp=20.0):
    rows = [("2023-01-01 10:00:00", "sensor_test", first_temp, 50.0, 1010.0, 90),
            ("2023-01-01 10:10:00", "sensor_test", None, 51.0, 1011.0, 85),
            ("2023-01-01 10:20:00", "sensor_test", 22.0, 52.0, 1012.0, 80)]
    return spark.createDataFrame(rows, SCHEMA)


def test_interpolation_fills_middle_value(spark):
    out = clean(f1(spark)).orderBy("timestamp").collect()
    assert out[1][C.TEMPERATURE] == 21.0
    assert len(out) == 3


def test_out_of_range_value_raises_with_report(spark):
    with pytest.raises(ContractViolation) as e:
        clean(f1(spark, 1000.0))
    # out-of-range values feed the interpolation, so the gap becomes (1000 + 22) / 2 = 511 as well
    assert e.value.summary == [("temperature_celsius", "less_than_or_equal_to(50)", 2)]
    assert sorted(x[-1] for x in e.value.examples) == [511.0, 1000.0]


def test_report_mode_keeps_rows(spark):
    assert clean(f1(spark, 1000.0), validation="report").count() == 3
    assert clean(f1(spark, 1000.0), validation="quarantine").count() == 1   # 1000 and the 511 it fed


def series(spark, values, device="d", start=dt.datetime(2024, 1, 1), step_s=60, battery=50.0):
    rows = [(start + dt.timedelta(seconds=i * step_s), device, v, 50.0, 1000.0, battery, i)
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, device_id string, temperature_celsius double, "
                                       "humidity_percent double, pressure_hpa double, "
                                       "battery_level_percent double, reading_id long")


def temps(df):
    return [r[C.TEMPERATURE] for r in df.orderBy("timestamp").collect()]


def test_edges_take_nearest_value(spark):
    df = series(spark, [None, 1.0, None, None, 4.0, None])
    assert temps(interpolate_linear(df)) == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_interpolation_is_positional_not_time_weighted(spark):
    df = series(spark, [0.0, None, 30.0])
    rows = [(dt.datetime(2024, 1, 1, 0, 0), 0.0), (dt.datetime(2024, 1, 1, 0, 1), None),
            (dt.datetime(2024, 1, 1, 5, 0), 30.0)]
    df = spark.createDataFrame([(t, "d", v, 1.0, 1.0, 1.0, i) for i, (t, v) in enumerate(rows)], df.schema)
    assert temps(interpolate_linear(df, segment_seconds=60)) == [0.0, 15.0, 30.0]


def test_all_missing_device_stays_missing_and_is_dropped(spark):
    df = series(spark, [None, None], device="empty").unionByName(series(spark, [5.0, None], device="ok"))
    assert [r[C.TEMPERATURE] for r in interpolate_linear(df).filter("device_id = 'empty'").collect()] == [None, None]
    cleaned = clean(df, validation="off")
    assert sorted(r.device_id for r in cleaned.collect()) == ["ok", "ok"]


def test_missing_battery_and_device_drop_the_row(spark):
    df = series(spark, [1.0, 2.0, 3.0])
    df = df.withColumn("battery_level_percent", F.when(F.col("reading_id") == 1, None)
                       .otherwise(F.col("battery_level_percent")))
    assert clean(df).count() == 2
    nodev = series(spark, [1.0, 2.0]).withColumn("device_id", F.lit(None).cast("string"))
    assert clean(nodev, validation="off").count() == 0


def test_missing_timestamp_sorts_last_and_still_interpolates(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, 0), "d", 1.0, 1.0, 1.0, 1.0, 0),
            (None, "d", 9.0, 1.0, 1.0, 1.0, 1),
            (dt.datetime(2024, 1, 1, 0, 1), "d", None, 1.0, 1.0, 1.0, 2)]
    df = spark.createDataFrame(rows, series(spark, [1.0]).schema)
    out = {r.reading_id: r[C.TEMPERATURE] for r in interpolate_linear(df).collect()}
    assert out[2] == 5.0   # between 1.0 (first) and 9.0 (the untimed row, sorted last)
    assert clean(df, validation="off").count() == 2


def test_extra_column_with_missing_value_drops_row(spark):
    df = series(spark, [1.0, 2.0]).withColumn("note", F.when(F.col("reading_id") == 0, "x"))
    assert clean(df).count() == 1


def model_interpolate(values):
    known = [(i, v) for i, v in enumerate(values) if v is not None]
    out = []
    for i, v in enumerate(values):
        if v is not None:
            out.append(v)
            continue
        prev = [(j, x) for j, x in known if j < i]
        nxt = [(j, x) for j, x in known if j > i]
        if prev and nxt:
            (pp, pv), (np_, nv) = prev[-1], nxt[0]
            out.append(pv + ((nv - pv) / (np_ - pp)) * (i - pp))
        elif prev or nxt:
            out.append((prev[-1] if prev else nxt[0])[1])
        else:
            out.append(None)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_segmented_scan_matches_plain_model_for_any_segment_width(spark, seed):
    rng = random.Random(seed)
    frames, expected = [], {}
    for d in range(4):
        n = rng.randint(1, 40)
        vals = [None if rng.random() < 0.4 else round(rng.uniform(-5, 40), 2) for _ in range(n)]
        steps = [rng.choice([1, 30, 61, 3600, 7300]) for _ in range(n)]
        t, ts = dt.datetime(2024, 1, 1), []
        for s in steps:
            t += dt.timedelta(seconds=s)
            ts.append(t)
        expected[f"d{d}"] = model_interpolate(vals)
        frames += [(ts[i], f"d{d}", vals[i], 1.0, 1.0, 1.0, d * 1000 + i) for i in range(n)]
    rng.shuffle(frames)
    df = spark.createDataFrame(frames, series(spark, [1.0]).schema).repartition(3)
    for width in (60, 3600, 10 ** 9):
        got = {}
        for r in interpolate_linear(df, segment_seconds=width).orderBy("timestamp", "reading_id").collect():
            got.setdefault(r.device_id, []).append(r[C.TEMPERATURE])
        for dev, exp in expected.items():
            assert got[dev] == pytest.approx(exp, nan_ok=True), (width, dev)
