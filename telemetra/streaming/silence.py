"""Per-device state on a stream: alarms for devices that fall silent, and readings that are sent again.

A device is silent when it reports nothing for longer than its limit. Its history is followed in event time, whatever the order in which readings arrive within the
watermark's delay. Time is cut into buckets as long as the limit, of which only the first and last reading are kept: a silence is never inside one.
When the watermark has passed a bucket its readings are final, and the time since the last reading of the bucket before is compared with the limit. So a
device's state is two readings a bucket of the delay, however many it sends, and a silence has its alarm as soon as the watermark passes
its limit, by a timer, without a further reading.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import config as C
from ..functions.columns import epoch_micros, epoch_seconds
from ..operators.warehouse import join_dimension

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPEN, ENDED = "open", "ended"
CHUNK = 256                             # buckets of a state entry
AT_ONCE = 20_000                        # readings of a device that are looked at together
NO_ID = (1 << 63) - 1                   # stands for a missing id, after all others
ALARM = T.StructType([T.StructField(C.DEVICE, T.StringType()), T.StructField(C.READING_ID, T.LongType()), T.StructField("silent_after", T.LongType()),
                      T.StructField("until", T.LongType()), T.StructField("limit", T.LongType()), T.StructField("kind", T.StringType())])


def _merged(parts: list):
    """First and last readings of several lists of buckets, each bucket once and ascending."""
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    bucket, t0, i0, t1, i1 = (np.concatenate(c) for c in zip(*parts))
    first, last = np.lexsort((i0, t0, bucket)), np.lexsort((i1, t1, bucket))
    edge = np.flatnonzero(np.diff(bucket[first]))
    a, b = first[np.concatenate([[0], edge + 1])], last[np.append(edge, len(last) - 1)]
    return bucket[a], t0[a], i0[a], t1[b], i1[b]


class SilenceProcessor(StatefulProcessor):
    """Rows (device, micros, limit_micros, reading_id), times in microseconds. Emits ``open`` when a silence passes the limit and ``ended`` when a reading ends it.

    Each call on the state is a message to the store, so buckets wait in chunks of ``CHUNK``: one entry each, four numbers (first and last time and id) a bucket."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long, id long, limit long, alarmed boolean, wake long")
        self.chunks = handle.getMapState("chunks", "chunk long", "bucket array<long>, t0 array<long>, id0 array<long>, t1 array<long>, id1 array<long>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.last.get() if self.last.exists() else None
        limit, fresh = state[2] if state else None, []
        while part := [(r["micros"], r[C.READING_ID], r["limit_micros"]) for r in itertools.islice(rows, AT_ONCE)]:
            if limit is None:
                limit = part[0][2]
            t, i, _ = np.array(part, np.int64).T
            fresh = [_merged([*fresh, (t // limit, t, i, t, i)])]         # two readings a bucket are held, however many there are
        old = self._chunks() if state else {}
        held = _merged([*old.values(), *fresh])
        yield from self._settle(key, timerValues, state or (None, None, limit, False, None), old, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        old = self._chunks()
        yield from self._settle(key, timerValues, self.last.get(), old, _merged(list(old.values())))

    def _chunks(self) -> dict:
        return {k[0]: tuple(np.array(c, np.int64) for c in v) for k, v in self.chunks.iterator()}

    def _settle(self, key, timerValues, state, old, held) -> Iterator[Row]:
        """Compare what the watermark has passed, keep the rest and wake up when the watermark next passes something."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        t, i, limit, alarmed, woken = state
        bucket, t0, i0, t1, i1 = held
        done = int(np.searchsorted(bucket, now // limit))         # those whose end, (bucket + 1) * limit, has passed
        out = []
        if done:
            before = np.concatenate([[t0[0] if t is None else t], t1[:done - 1]])
            for k in np.flatnonzero(t0[:done] - before > limit).tolist():
                after, who = (int(t1[k - 1]), int(i1[k - 1])) if k else (t, i)
                if k or not alarmed:
                    out.append((key[0], who, after, None, limit, OPEN))
                out.append((key[0], who, after, int(t0[k]), limit, ENDED))
            t, i, alarmed = int(t1[done - 1]), int(i1[done - 1]), False
        left = tuple(c[done:] for c in held)
        # silent as far as is known: no reading waits that the limit would cover
        if t is not None and not alarmed and now > t + limit and (not len(left[0]) or int(left[1][0]) - t > limit):
            out.append((key[0], i, t, None, limit, OPEN))
            alarmed = True
        self._keep(old, left)
        wakes = [(int(left[0][0]) + 1) * limit] if len(left[0]) else []
        wakes += [t + limit + 1] if t is not None and not alarmed else []
        wake = max(-(-min(wakes) // 1000), now // 1000 + 1) if wakes else None
        if wake != woken:
            if woken is not None and woken > now // 1000:         # one that has fired is gone
                self.handle.deleteTimer(woken)
            if wake is not None:
                self.handle.registerTimer(wake)
        self.last.update((t, i, limit, alarmed, wake))
        alarm = Row(*ALARM.names)
        yield from (alarm(*r) for r in out)

    def _keep(self, old, left) -> None:
        """Write the chunks that differ from the stored ones; those of which nothing waits go."""
        chunk = left[0] // CHUNK
        starts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(chunk) else np.zeros(0, np.int64)
        waiting = {int(chunk[a]): tuple(c[a:b] for c in left) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(chunk)])}
        for k in old.keys() - waiting.keys():
            self.chunks.removeKey((k,))
        for k, v in waiting.items():
            if k not in old or not all(np.array_equal(x, y) for x, y in zip(v, old[k])):
                self.chunks.updateValue((k,), tuple(c.tolist() for c in v))

    def close(self) -> None:
        pass


def silence_alarms(readings: DataFrame, limits: DataFrame, default_seconds: int | None = None, delay: str = "1 day") -> DataFrame:
    """Alarms of a stream of readings: device_id, reading_id and silent_after (the last reading before the silence), until (the reading that ended it; NULL
    while ``kind`` is ``open``), limit_seconds.

    ``limits``: (device_id, limit_seconds), a static table. A device without a limit has ``default_seconds``; without that too it is not watched. A device keeps the
    limit with which it was first seen. Readings without a device or a time take no part; those later than ``delay`` are dropped by the
    watermark. The same silence is emitted once as ``open`` and, when a reading ends it, once as ``ended``, also over restarts.
    """
    dtype = readings.schema[C.TIMESTAMP].dataType
    limit = F.coalesce("limit_seconds", F.lit(default_seconds).cast("long"))
    micros = epoch_micros(C.TIMESTAMP, dtype)
    rows = (join_dimension(readings.select(C.DEVICE, C.TIMESTAMP, F.coalesce(F.col(C.READING_ID).cast("long"), F.lit(NO_ID)).alias(C.READING_ID)), limits.select(C.DEVICE, "limit_seconds"))
            .select(C.DEVICE, F.timestamp_micros(micros).alias("event_time"), micros.alias("micros"), F.when(limit.isNotNull(), F.greatest(limit, F.lit(1)) * 1_000_000).cast("long").alias("limit_micros"), C.READING_ID)
            .filter(F.col(C.DEVICE).isNotNull() & F.col("micros").isNotNull() & F.col("limit_micros").isNotNull())
            .withWatermark("event_time", delay))
    alarms = rows.groupBy(C.DEVICE).transformWithState(SilenceProcessor(), ALARM, "Append", "EventTime")
    wall = "timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(cast({0} as decimal(20,0)) / 1000000 as decimal(18,6)))"
    time = lambda c: F.expr(wall.format(c)) if dtype == T.TimestampNTZType() else F.timestamp_micros(c)
    return alarms.select(C.DEVICE, F.nullif(F.col(C.READING_ID), F.lit(NO_ID)).alias(C.READING_ID), time("silent_after").alias("silent_after"), time("until").alias("until"), F.floor(F.col("limit") / 1_000_000).alias("limit_seconds"), "kind")


def keyed_state(spark) -> None:
    """Keyed state lives in the store that spills to disk; a setting of the session, read when a stream starts."""
    if spark.conf.get(STATE_STORE, None) != ROCKSDB:
        spark.conf.set(STATE_STORE, ROCKSDB)


def once_on_stream(readings: DataFrame, keys: list[str] = (C.DEVICE, C.TIMESTAMP), delay: str = "1 day") -> DataFrame:
    """The stream without readings that are sent again within ``delay``: of those with equal ``keys`` the first to arrive stays. The state is the keys
    of one delay; the watermark lets older ones go."""
    at = F.timestamp_seconds(epoch_seconds(C.TIMESTAMP, readings.schema[C.TIMESTAMP].dataType))
    return readings.withColumn("_event_time", at).withWatermark("_event_time", delay).dropDuplicatesWithinWatermark(list(keys)).drop("_event_time")


def once(readings: DataFrame, keys: list[str] = (C.DEVICE, C.TIMESTAMP), order: str = C.READING_ID) -> DataFrame:
    """Of readings with equal ``keys``, the one with the smallest ``order`` (of equal ones any, once). One aggregate, combined map-side: a reading sent a
    million times is one row a task. Rows with a NULL key are readings of their own, each kept."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    rest = [c for c in readings.columns if c not in keys]
    first = readings.filter(whole).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in readings.columns])
    return first.unionByName(readings.filter(~whole))
