"""Joins of intervals against brute force."""
import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from telemetra.operators import intervals as I

SCHEMA = "device string, id int, since timestamp_ntz, until timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def spans(seed, n, devices, longest):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = T0 + dt.timedelta(seconds=rng.randrange(200_000))
        out.append((rng.choice(devices), i, s, None if rng.random() < 0.03 else s + dt.timedelta(microseconds=int(10 ** rng.uniform(0, longest)))))
    return out


def brute(a, b, closed=False):
    got = Counter()
    for d, i, s, e in a:
        for f, j, u, v in b:
            if d is None or d != f or s is None or u is None:
                continue
            one = dt.timedelta(microseconds=1) if closed else dt.timedelta(0)
            e2, v2 = (e + one if e else dt.datetime.max), (v + one if v else dt.datetime.max)
            if s < e2 and u < v2 and max(s, u) < min(e2, v2):
                end = min(e2, v2)
                got[i, j, None if end == dt.datetime.max else (end - max(s, u)) // dt.timedelta(microseconds=1)] += 1
    return got


ODD = [("x", 900, T0, T0), ("x", 901, T0, T0 - dt.timedelta(1)), ("x", 902, None, T0), (None, 903, T0, None), ("x", 904, T0, T0 + dt.timedelta(days=4000)),
       ("x", 905, dt.datetime(1960, 1, 1), dt.datetime(1975, 1, 1)), ("x", 906, dt.datetime(1965, 1, 1), None), ("x", 907, T0, T0 + dt.timedelta(microseconds=1)), ("x", 907, T0, T0 + dt.timedelta(microseconds=1))]


@pytest.mark.parametrize("closed", [False, True])
def test_equals_brute_force(spark, closed):
    a, b = spans(1, 400, ["x", "x", "y", "z"], 11.5) + ODD, spans(2, 150, ["x", "y", "w"], 12) + ODD
    frames = [spark.createDataFrame(r, SCHEMA).repartition(4).withColumn("_level", F.lit("other")).withColumn("left", F.lit(1)) for r in (a, b)]
    got = I.interval_join(*frames, ["device"], ("since", "until"), ("since", "until"), closed).select(F.col("left.id").alias("i"), F.col("right.id").alias("j"), "overlap_micros").collect()
    assert Counter(tuple(r) for r in got) == brute(a, b, closed)


def test_one_very_long_interval_costs_each_other_a_row_or_two(spark):
    a = spark.createDataFrame([("x", i, T0 + dt.timedelta(minutes=i), T0 + dt.timedelta(minutes=i + 1)) for i in range(5000)], SCHEMA)
    b = spark.createDataFrame([("x", 0, T0 - dt.timedelta(days=3000), T0 + dt.timedelta(days=3000)), ("x", 1, T0, T0 + dt.timedelta(minutes=3))], SCHEMA)
    s = I._sided(a, "since", "until", False)
    levels = sorted({r[0] for d in (a, b) for r in I._sided(d, "since", "until", False).select("_own").distinct().collect()})
    listed = I._listed(s, F.array(*[F.lit(k) for k in levels]))
    assert listed.count() <= 2 * 5000 * len(levels) and len(levels) == 3
    out = I.interval_join(a, b, ["device"], ("since", "until"), ("since", "until"))
    assert out.count() == 5003
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_empty_tables(spark):
    a = spark.createDataFrame(spans(1, 5, ["x"], 5), SCHEMA)
    for x, y in ((a, a.limit(0)), (a.limit(0), a), (a.limit(0), a.limit(0))):
        assert I.interval_join(x, y, ["device"], ("since", "until"), ("since", "until")).count() == 0
