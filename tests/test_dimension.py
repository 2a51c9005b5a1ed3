"""Loads into a stored dimension: keys stay, versions are whole."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from telemetra import config as C
from telemetra.operators import dimension as D, warehouse as wh

SCHEMA = "timestamp timestamp_ntz, device_id string"
T0 = dt.datetime(2024, 1, 1)


def load(spark, *pairs):
    return spark.createDataFrame([(None if s is None else T0 + dt.timedelta(seconds=s), d) for d, s in pairs], SCHEMA)


def test_keys_of_known_devices_stay(spark, tmp_out):
    t = D.VersionedTable(spark, f"{tmp_out}/dim")
    assert t.version() == 0 and t.read() is None
    first = {r.device_id: r for r in D.load_devices(t, load(spark, ("m", 0), ("m", 100), ("z", 5), (None, 1))).collect()}
    assert {d: r.device_key for d, r in first.items()} == {"m": 1, "z": 2}
    second = {r.device_id: r for r in D.load_devices(t, load(spark, ("a", 7), ("m", 400), ("n", 1), ("n", 31), ("q", None))).collect()}
    assert {d: r.device_key for d, r in second.items()} == {"m": 1, "z": 2, "a": 3, "n": 4, "q": 5}       # "a" sorts first
    assert (second["m"].created_at, second["m"].last_seen, second["m"].n_readings) == (T0, T0 + dt.timedelta(seconds=400), 3)
    assert second["m"].expected_interval_seconds == 200 and second["n"].sensor_category == "High-Frequency"
    assert second["z"] == first["z"] and second["q"].sensor_category == "On-Event"
    assert D.load_devices(t, load(spark)).count() == 5 and t.version() == 3
    assert {r.device_id for r in t.read(1).collect()} == {"m", "z"}


def test_stored_facts_still_point_at_their_devices(spark, tmp_out):
    t = D.VersionedTable(spark, f"{tmp_out}/dim")
    one, two = load(spark, ("b", 0), ("d", 1)), load(spark, ("a", 2), ("d", 3), ("c", 4))
    facts = []
    for part in (one, two):
        dim = D.load_devices(t, part)
        facts.append(wh.join_dimension(part, dim.select(C.DEVICE, "device_key")).withColumnRenamed(C.DEVICE, "was"))
        facts[-1].write.mode("append").parquet(f"{tmp_out}/fact")
    back = spark.read.parquet(f"{tmp_out}/fact").join(t.read(), "device_key")
    assert back.count() == 5 and back.filter(F.col("was") != F.col(C.DEVICE)).count() == 0


def test_one_load_equals_the_plain_dimension(spark):
    from telemetra.sources.events import load_readings
    from conftest import SF_SMALL
    r = load_readings(spark, SF_SMALL)
    cols = ["device_key", "device_id", "created_at", "expected_interval_seconds", "sensor_category"]
    assert sorted(D.merge_devices(None, r).select(cols).collect()) == sorted(wh.dim_devices(r).select(cols).collect())


def test_a_failed_load_changes_nothing_and_a_double_one_is_found(spark, tmp_out):
    t = D.VersionedTable(spark, f"{tmp_out}/dim")
    D.load_devices(t, load(spark, ("a", 1)))
    with pytest.raises(Exception):
        D.load_devices(t, load(spark, ("b", 1)).withColumn(C.DEVICE, F.raise_error(F.lit("broken")).cast("string")))
    assert t.version() == 1 and [r.device_id for r in t.read().collect()] == ["a"]
    spark.createDataFrame([(1, "data/other")], D.LOG).write.mode("append").parquet(f"{tmp_out}/dim/log")
    with pytest.raises(ValueError, match="published 2 times"):
        t.read()


def test_numbers_are_dense_over_many_tasks(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("v")).repartition(7)
    got = D.numbered(df, [F.col("v").asc()], "k", 5).orderBy("v").collect()
    assert [r.k for r in got] == list(range(5, 1005))
