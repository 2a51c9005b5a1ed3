"""Time-range windows against brute force: hot and bursty devices, windows over many panes, edges and ties."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from telemetra import config as C
from telemetra.operators import range_frames as R

SCHEMA = "device_id string, timestamp timestamp_ntz, temperature_celsius double, reading_id long"
T0 = dt.datetime(2024, 1, 1)


def rows():
    rng = random.Random(2)
    out = [("hot", T0 + dt.timedelta(seconds=rng.randrange(86_400)), rng.choice([None, float("nan"), rng.uniform(-5, 40)]), i) for i in range(700)]
    out += [("burst", T0 + dt.timedelta(hours=20, milliseconds=rng.randrange(60_000)), rng.uniform(0, 1), 1000 + i) for i in range(300)]
    out += [("burst", T0 + dt.timedelta(hours=5 * k), float(k), 2000 + k) for k in range(12)]
    out += [("edge", T0 + dt.timedelta(hours=h, microseconds=m), float(h + m), 3000 + 10 * h + m) for h in range(0, 30, 2) for m in (0, 1)]
    out += [("tie", T0, float(k), 4000 + k) for k in range(40)] + [("none", T0 + dt.timedelta(hours=k), None, 5000 + k) for k in range(5)]
    out += [("old", dt.datetime(1969, 12, 31, 20) + dt.timedelta(hours=k), float(k), 6000 + k) for k in range(12)]
    out += [(None, T0, 1.0, 7000), ("hot", None, 1.0, 7001), (None, None, None, 7002), ("hot", T0, 9.0, 7003), ("hot", T0, 9.0, 7003)]
    return out


def brute(data, window):
    want = []
    for d, t, v, i in data:
        if d is None or t is None:
            want.append((i, None, None, None, None))
            continue
        vs = [x for e, u, x, _ in data if e == d and u is not None and t - window <= u <= t and x is not None and x == x]
        want.append((i, len(vs), round(sum(vs) / len(vs), 9) if vs else None, min(vs, default=None), max(vs, default=None)))
    return sorted(want, key=lambda r: (r[0], str(r)))


@pytest.mark.parametrize("window,target", [(dt.timedelta(hours=6), 1_000_000), (dt.timedelta(hours=6), 20), (dt.timedelta(seconds=90), 5), (dt.timedelta(days=3), 10), (dt.timedelta(microseconds=7), 1)])
def test_equals_brute_force(spark, window, target):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = R.rolling_range(df, window=window, name="w", target_rows=target)
    assert got.columns == [*df.columns, "w_count", "w_mean", "w_min", "w_max"]
    assert sorted(((r.reading_id, r.w_count, None if r.w_mean is None else round(r.w_mean, 9), r.w_min, r.w_max) for r in got.collect()), key=lambda r: (r[0], str(r))) == brute(data, window)


def test_panes_are_bounded_by_rows(spark):
    df = spark.createDataFrame(rows(), SCHEMA).filter("device_id IS NOT NULL AND timestamp IS NOT NULL")
    micros = 6 * 3_600_000_000
    t = df.select("device_id", R.epoch_micros(C.TIMESTAMP, df.schema[C.TIMESTAMP].dataType).alias("_t"))
    levels = R.pane_levels(t, "device_id", micros, 40)
    by = {r.device_id: r._level for r in levels.collect()}
    assert by["edge"] == by["none"] == 0 and by["hot"] >= 2 and by["burst"] > by["hot"]
    sizes = t.join(levels, "device_id").groupBy("device_id", F.expr(f"floor(_t / ({micros} / pow(2, _level)))")).count().groupBy("device_id").agg(F.max("count").alias("n")).collect()
    assert all(r.n <= 40 for r in sizes if r.device_id != "burst")
    assert next(r.n for r in sizes if r.device_id == "burst") < 200       # 300 rows in a minute, of a window of six hours


def test_rows_are_shuffled_once_without_python(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    plan = R.rolling_range(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert R.rolling_range(df.filter("false")).count() == 0
