"""Streams: several micro-batches give the batch answer in any order of arrival; late rows are set aside; restarts go on."""
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from telemetra import config as C
from telemetra.operators.timeseries import rolling_mean_3
from telemetra.sources.events import events_path, load_readings
from telemetra.streaming import jobs

from conftest import SF_SMALL


def split_events(spark, out, parts=4):
    """The small events table cut into time-ordered files, so a stream reads it in several batches."""
    ev = spark.read.parquet(events_path(SF_SMALL))
    bounds = ev.approxQuantile("event_id", [i / parts for i in range(1, parts)], 0.0)
    lo = None
    for i, hi in enumerate(bounds + [None]):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col("event_id") > lo)
        if hi is not None:
            cond = cond & (F.col("event_id") <= hi)
        ev.filter(cond).coalesce(1).write.parquet(os.path.join(out, f"part{i}"))
        lo = hi
    return [os.path.join(out, f"part{i}") for i in range(parts)]


def land_files(folders, land, first=0):
    """Put one file of each folder into ``land``, to be read in this order."""
    os.makedirs(land, exist_ok=True)
    for i, d in enumerate(folders, first):
        f = [x for x in os.listdir(d) if x.endswith(".parquet")][0]
        to = os.path.join(land, f"events-{i:02d}.parquet")
        os.link(os.path.join(d, f), to)
        os.utime(to, (1_700_000_000 + i, 1_700_000_000 + i))


def stream_of(spark, land):
    schema = spark.read.parquet(events_path(SF_SMALL)).schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(land)
    return jobs.readings_from_events(src)


def batch_rolling(spark):
    r = load_readings(spark, SF_SMALL).filter(F.col(C.TEMPERATURE).isNotNull())
    return sorted(((r.reading_id, r[C.ROLLING]) for r in rolling_mean_3(r).collect()))


def pairs(df):
    return sorted((r.reading_id, r[C.ROLLING]) for r in df.collect())


@pytest.mark.parametrize("arrival, delay", [((0, 1, 2, 3), "1 day"), ((2, 0, 3, 1), "40000 days")])
def test_rolling_equals_batch_for_any_order_of_files(spark, tmp_out, arrival, delay):
    parts = split_events(spark, os.path.join(tmp_out, "split"))
    land = os.path.join(tmp_out, "land")
    land_files([parts[i] for i in arrival], land)
    got = jobs.rolling_alerts(stream_of(spark, land), os.path.join(tmp_out, "work"), delay)
    assert pairs(got) == batch_rolling(spark)
    if delay == "1 day":
        assert got.filter("closed").count() > 0 and jobs.late_readings(spark, os.path.join(tmp_out, "work")).count() == 0


def test_rolling_goes_on_from_its_checkpoint(spark, tmp_out):
    parts = split_events(spark, os.path.join(tmp_out, "split"))
    land, work = os.path.join(tmp_out, "land"), os.path.join(tmp_out, "work")
    land_files(parts[:2], land)
    first = jobs.rolling_alerts(stream_of(spark, land), work).count()
    land_files(parts[2:], land, 2)
    got = jobs.rolling_alerts(stream_of(spark, land), work)
    want = batch_rolling(spark)
    assert 0 < first < len(want) and pairs(got) == want
    assert pairs(jobs.rolling_alerts(stream_of(spark, land), work)) == want        # nothing new: nothing changes


def test_late_readings_are_set_aside(spark, tmp_out):
    parts = split_events(spark, os.path.join(tmp_out, "split"))
    land, work = os.path.join(tmp_out, "land"), os.path.join(tmp_out, "work")
    times = [spark.read.parquet(p).agg(F.max("ts")).first()[0] for p in parts]
    land_files([parts[times.index(max(times))]] + [p for p, t in zip(parts, times) if t != max(times)], land)
    got = {i for i, _ in pairs(jobs.rolling_alerts(stream_of(spark, land), work, "0 days"))}
    late = {r.reading_id for r in jobs.late_readings(spark, work).collect()}
    assert late and not late & got and late | got == {i for i, _ in batch_rolling(spark)}


def test_daily_stream_drops_late_rows_and_goes_on(spark, tmp_out):
    schema = "timestamp timestamp_ntz, device_id string, temperature_celsius double, humidity_percent double, battery_level_percent double, n int"
    land, work = os.path.join(tmp_out, "land"), os.path.join(tmp_out, "work")
    def arrive(n, *days):
        rows = [(datetime(2024, 1, d, 12), "a", float(d), 50.0, 80.0, n) for d in days]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)
        s = spark.readStream.schema(schema).parquet(land)
        got = jobs.run_to_parquet(spark, jobs.daily_stats_stream(s, "1 day"), "daily", work=work)
        return sorted((r.date.day, r.readings) for r in got.collect())
    assert arrive(1, 1, 1, 2, 5) == [(1, 2), (2, 1)]
    assert arrive(2, 1, 4, 9) == [(1, 2), (2, 1), (4, 1), (5, 1)]               # the third reading of day 1 came too late


def test_routing_keeps_every_reading(spark):
    routed = jobs.run_to_parquet(spark, jobs.contract_routed(jobs.stream_readings(spark, SF_SMALL)), "t1-routed", partition_by=("passes",))
    got = {r.passes: r.n for r in routed.groupBy("passes").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got[True] and got[False] and sum(got.values()) == load_readings(spark, SF_SMALL).count()
    assert routed.filter(F.col("passes") != (F.col("contract_failures") == 0)).count() == 0


def test_alerts_and_daily_stream(spark):
    alerts = jobs.run_to_parquet(spark, jobs.contract_alerts(jobs.stream_readings(spark, SF_SMALL)), "t1")
    assert alerts.filter(~F.col("low_battery") & (F.col("contract_failures") == 0)).count() == 0
    daily = jobs.run_to_parquet(spark, jobs.daily_stats_stream(jobs.stream_readings(spark, SF_SMALL)), "t2")
    ev = spark.read.parquet(events_path(SF_SMALL))
    last = ev.agg(F.max("ts")).first()[0]
    # only days that closed before the watermark (latest event minus one day) are emitted
    assert daily.filter(F.date_add(F.col("date"), 2) > F.lit(last.date())).count() == 0
    assert daily.count() > 0
