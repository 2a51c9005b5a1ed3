"""Parquet and CSV stores: round trips, re-runs, partition pruning."""
import os

import pytest

from telemetra import config as C
from telemetra.operators.filters import date_range_filter
from telemetra.sinks.files import load_to_storage, write_csv, write_parquet
from telemetra.sources.events import load_readings

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def readings(spark):
    return load_readings(spark, SF_SMALL).dropna()


def test_parquet_round_trip_append_and_overwrite(spark, readings, tmp_out):
    path = os.path.join(tmp_out, "store")
    n = readings.count()
    write_parquet(readings, path)
    back = spark.read.parquet(path)
    assert back.count() == n
    assert back.schema[C.DATE].dataType.simpleString() == "date"
    assert sorted(back.drop(C.DATE).collect()) == sorted(readings.collect())
    write_parquet(readings, path)                       # a re-run appends
    assert spark.read.parquet(path).count() == 2 * n
    write_parquet(readings, path, overwrite_touched_partitions=True)   # idempotent re-run
    assert spark.read.parquet(path).count() == n


def test_date_filter_prunes_partitions(spark, readings, tmp_out):
    path = os.path.join(tmp_out, "pruned")
    write_parquet(readings, path)
    df = date_range_filter(spark.read.parquet(path), "2024-01-03", "2024-01-04")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert {str(r.date) for r in df.select("date").distinct().collect()} == {"2024-01-03", "2024-01-04"}


def test_csv_round_trip_keeps_microseconds(spark, readings, tmp_out):
    path = os.path.join(tmp_out, "csv")
    write_csv(readings, path)
    back = (spark.read.option("header", True).schema(readings.schema.add("date", "date")).csv(path))
    assert sorted(back.drop("date").collect()) == sorted(readings.collect())


def test_unknown_format_raises(readings, tmp_out):
    with pytest.raises(ValueError, match="Unsupported format"):
        load_to_storage(readings, "xlsx", tmp_out)
