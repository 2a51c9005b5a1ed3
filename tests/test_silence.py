"""Silence alarms and repeated readings on a stream, against batch and brute force, over several micro-batches and restarts."""
import datetime as dt
import os
import random

from pyspark.sql import functions as F

from telemetra import config as C
from telemetra.streaming import silence as S
from telemetra.streaming.jobs import run_to_parquet

SCHEMA = "timestamp timestamp_ntz, device_id string, reading_id long"
T0 = dt.datetime(2024, 5, 1)
LIMITS = "device_id string, limit_seconds long"


def history():
    rng = random.Random(12)
    rows = []
    for d, step in {"quick": 50, "slow": 4000, "still": 100}.items():
        t = 0
        for _ in range(150 if d != "still" else 20):
            t += int(step * rng.choice([0.1, 0.5, 1, 1, 1.5, 2, 2.1, 3, 9]))
            rows.append((T0 + dt.timedelta(seconds=t), d, len(rows)))
    return rows + [(T0, "once", 900), (None, "quick", 901), (T0, None, 902), (T0, "unwatched", 903), (T0 + dt.timedelta(days=9), "clock", 904), (T0 + dt.timedelta(days=10), "clock", 905)]


def gaps(rows, limits):
    by = {}
    for t, d, i in rows:
        if t is not None and d in limits:
            by.setdefault(d, []).append((t, i))
    out = set()
    for d, ts in by.items():
        ts.sort()
        out |= {(d, i, t, u) for (t, i), (u, _) in zip(ts, ts[1:]) if (u - t).total_seconds() > limits[d]}
    return out, {d: max(ts) for d, ts in by.items()}


def test_alarms_over_batches_and_restarts(spark, tmp_out):
    S.keyed_state(spark)
    rows, limits = history(), {"quick": 100, "slow": 8000, "still": 200, "once": 60, "clock": 3600}
    table = spark.createDataFrame(list(limits.items()), LIMITS)
    frame = lambda rs: spark.createDataFrame(rs, SCHEMA)
    rng = random.Random(3)
    parts = sorted(rows, key=lambda r: (r[0] or T0).timestamp() + rng.uniform(0, 3 * 3600))      # out of order by less than the delay
    cuts = [0, 40, 41, 150, 260, len(parts)]
    os.makedirs(f"{tmp_out}/in")
    stream = spark.readStream.schema(frame(rows[:1]).schema).parquet(f"{tmp_out}/in")
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        frame(parts[a:b]).coalesce(1).write.mode("append").parquet(f"{tmp_out}/in")
        if k in (1, 2, 4):                                                                       # each time a new query goes on from the checkpoint
            got = run_to_parquet(spark, S.silence_alarms(stream, table, delay="4 hours"), "x", work=f"{tmp_out}/work").collect()
    want, last = gaps(rows, limits)
    ended = [(r.device_id, r.reading_id, r.silent_after, r.until) for r in got if r.kind == S.ENDED]
    opened = [(r.device_id, r.reading_id) for r in got if r.kind == S.OPEN]
    mark = max(t for t, d, _ in rows if t and d in limits) - dt.timedelta(hours=4)
    micros = lambda t: int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    final = {w for w in want if (micros(w[3]) // (limits[w[0]] * 10**6) + 1) * limits[w[0]] * 10**6 <= micros(mark)}
    assert set(ended) == final and len(ended) == len(final) and len(final) > 50
    silent = {(d, i) for d, (t, i) in last.items() if t + dt.timedelta(seconds=limits[d]) < mark}
    begun = {w[:2] for w in want - final if w[2] + dt.timedelta(seconds=limits[w[0]]) < mark}
    assert set(opened) == {w[:2] for w in final} | silent | begun and len(set(opened)) == len(opened)


def test_readings_sent_again(spark, tmp_out):
    rows = [(T0 + dt.timedelta(minutes=k % 50), "d%d" % (k % 3), k) for k in range(300)]
    keys = {(t, d) for t, d, _ in rows}
    os.makedirs(f"{tmp_out}/in")
    stream = spark.readStream.schema(spark.createDataFrame(rows[:1], SCHEMA).schema).parquet(f"{tmp_out}/in")
    for part in (rows[:100], rows[50:200], rows[:300]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{tmp_out}/in")
        got = run_to_parquet(spark, S.once_on_stream(stream), "x", work=f"{tmp_out}/work")
    assert sorted((r.timestamp, r.device_id) for r in got.collect()) == sorted(keys)
    batch = spark.createDataFrame(rows + rows + [(None, "d0", 1), (None, "d0", 1), (T0, None, 2)], SCHEMA)
    want = sorted((min(i for u, e, i in rows if (u, e) == k), *k) for k in keys)
    assert sorted((r.reading_id, r.timestamp, r.device_id) for r in S.once(batch).filter("timestamp IS NOT NULL AND device_id IS NOT NULL").collect()) == want
    assert S.once(batch).count() == len(keys) + 3


class Store:
    """The state of one device, and the messages sent to it."""

    def __init__(self):
        self.value, self.map, self.timers, self.calls = {}, {}, set(), 0

    def __getattr__(self, name):
        return {"getValueState": lambda k, *_: Part(self, self.value, k), "getMapState": lambda k, *_: Part(self, self.map, None)}[name]

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))


class Part:
    def __init__(self, store, held, key):
        self.store, self.held, self.key = store, held, key

    def __getattr__(self, name):
        self.store.calls += 1
        h, k = self.held, self.key
        return {"exists": lambda: k in h, "get": lambda: h.get(k), "update": lambda v: h.update({k: v}), "containsKey": lambda x: x in h, "getValue": lambda x: h.get(x),
                "updateValue": lambda x, v: h.update({x: v}), "removeKey": lambda x: h.pop(x), "iterator": lambda: iter(list(h.items()))}[name]


class Clock:
    def __init__(self, millis):
        self.millis = millis

    def getCurrentWatermarkInMs(self):
        return self.millis


def test_messages_to_the_store_do_not_grow_with_the_buckets():
    from pyspark.sql import Row
    store, limit, n = Store(), 10**6, 3000
    p = S.SilenceProcessor()
    p.init(store)
    rows = [Row(device_id="d", micros=k * limit + (k % 7) * 1000 + 10 * r, limit_micros=limit, reading_id=2 * k + r) for k in range(n) for r in range(2) if k % 10]
    want = [(a.reading_id, a.micros, b.micros) for a, b in zip(rows, rows[1:]) if b.micros - a.micros > limit]
    random.Random(1).shuffle(rows)
    assert list(p.handleInputRows(("d",), iter(rows), Clock(0))) == []
    out = list(p.handleExpiredTimer(("d",), Clock(n * 1000), None))
    assert [(r.reading_id, r.silent_after, r.until) for r in out if r.kind == S.ENDED] == want and len(out) == 2 * len(want) and len(want) > 299
    assert store.calls < 60 and not store.map


def test_readings_without_an_id(spark, tmp_out):
    S.keyed_state(spark)
    rows = [(T0, "d", None), (T0 + dt.timedelta(hours=1), "d", 5), (T0 + dt.timedelta(hours=2), "d", None), (T0 + dt.timedelta(days=3), "e", 7)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_out}/in")
    stream = spark.readStream.schema(spark.createDataFrame(rows[:1], SCHEMA).schema).parquet(f"{tmp_out}/in")
    limits = spark.createDataFrame([("d", 600), ("e", 600)], LIMITS)
    got = run_to_parquet(spark, S.silence_alarms(stream, limits), "x", work=f"{tmp_out}/work").collect()
    assert sorted((r.reading_id or 0, r.silent_after, r.until) for r in got if r.kind == S.ENDED) == [(0, T0, rows[1][0]), (5, rows[1][0], rows[2][0])]
    assert [(r.reading_id, r.silent_after) for r in got if r.kind == S.OPEN and r.silent_after == rows[2][0]] == [(None, rows[2][0])]
