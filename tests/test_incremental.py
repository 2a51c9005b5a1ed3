"""Late loads: the store is that of a full run, and only reached dates are rewritten."""
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from telemetra import config as C
from telemetra.plans import etl, incremental as N

SCHEMA = ("timestamp timestamp_ntz, device_id string, temperature_celsius double, humidity_percent double, "
          "pressure_hpa double, battery_level_percent double, reading_id long")
T0 = dt.datetime(2024, 3, 1)


def history(seed=4):
    """Devices with long gaps, days without an anchor, a device never known, one that starts late."""
    rng = random.Random(seed)
    rows = []
    for d, (share, days) in {"dense": (0.05, range(14)), "gappy": (0.6, range(14)), "silent": (0.1, (0, 1, 9, 13)), "blank": (1.0, range(5)), "new": (0.2, range(8, 12))}.items():
        for day in days:
            for _ in range(rng.randrange(1, 7)):
                t = T0 + dt.timedelta(days=day, seconds=rng.randrange(86_400))
                v = [None if rng.random() < share else round(rng.uniform(0, 40), 2) for _ in range(3)]
                rows.append((t, d, *v, None if rng.random() < 0.1 else 50.0, len(rows)))
    return rows + [(None, "dense", 1.0, 1.0, 1.0, 1.0, 9000), (T0, None, 1.0, 1.0, 1.0, 1.0, 9001), (rows[3][0], rows[3][1], 7.0, float("nan"), 7.0, 7.0, 9002)]


def files(root):
    return {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{root}/processed") for f in fs if f.endswith(".parquet")}


def content(df):
    return sorted(tuple(sorted(r.asDict().items())) for r in df.collect())


CASES = {
    "one day": lambda r: r[1] == "gappy" and r[0] and r[0].date() == dt.date(2024, 3, 6),
    "ends, whole devices, odd rows": lambda r: r[6] >= 9000 or r[1] in ("new", "blank") or (r[1] == "dense" and r[0] and r[0].date() in (dt.date(2024, 3, 1), dt.date(2024, 3, 14))),
}


@pytest.mark.parametrize("case", list(CASES))
def test_store_equals_a_full_run(spark, tmp_out, case):
    rows = history()
    late = [r for r in rows if CASES[case](r)]
    frame = lambda rs: spark.createDataFrame(rs, SCHEMA).repartition(3)
    N.build(frame([r for r in rows if r not in late]), tmp_out)
    before = files(tmp_out)
    change = N.add_late(spark, tmp_out, frame(late), "late")
    after = files(tmp_out)
    want = etl.run(frame(rows), validation="report").classified
    assert content(N.processed(spark, tmp_out).drop(C.DATE)) == content(want)
    dates = {f"date={d}" for d in change.dates}
    assert {k: v for k, v in before.items() if os.path.basename(k[0]) not in dates} == {k: v for k, v in after.items() if os.path.basename(k[0]) not in dates}
    if case == "one day":
        assert 1 <= len(dates) < 14 and {r.device_id for r in change.recomputed.collect()} == {"gappy"}
        again = N.add_late(spark, tmp_out, frame(late), "late")        # a load that is repeated
        assert content(N.processed(spark, tmp_out).drop(C.DATE)) == content(want) and again.dates == change.dates


def test_loads_one_after_another(spark, tmp_out):
    rows = history(9)
    N.build(spark.createDataFrame(rows[::3], SCHEMA), tmp_out)
    for k in (1, 2):
        N.add_late(spark, tmp_out, spark.createDataFrame(rows[k::3], SCHEMA), f"load-{k}")
    assert content(N.processed(spark, tmp_out).drop(C.DATE)) == content(etl.run(spark.createDataFrame(rows, SCHEMA), validation="report").classified)
    assert N.add_late(spark, tmp_out, spark.createDataFrame([], SCHEMA), "none").dates == []


def test_reach_stops_at_anchors(spark):
    day = lambda k: dt.date(2024, 3, 1 + k)
    days = spark.createDataFrame([("a", day(k), k in (0, 2, 5, 6, 9)) for k in range(11)] + [("b", day(0), True)], "device_id string, date date, anchor boolean")
    changed = spark.createDataFrame([("a", day(4)), ("a", day(10)), ("a", day(2)), ("c", day(3))], "device_id string, date date")
    got = {(r.device_id, r.date): (r.lo, r.lo2, r.hi, r.hi2) for r in N.reach(days, changed).collect()}
    assert got == {("a", day(4)): (day(2), day(0), day(5), day(6)), ("a", day(10)): (day(9), day(6), None, None),
                   ("a", day(2)): (day(0), None, day(5), day(6)), ("c", day(3)): (None, None, None, None)}
