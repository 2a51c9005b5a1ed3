"""Plan shape: one shuffle of the readings, pushed filters, no Python in the batch path."""
from telemetra import classify, clean, daily_stats, transform
from telemetra.operators.filters import device_readings
from telemetra.sources.events import load_device_readings, load_readings

from conftest import SF_SMALL


def final_plan(df):
    df.collect()
    s = df._jdf.queryExecution().executedPlan().toString()
    return s.split("== Initial Plan ==")[0] if "== Initial Plan ==" in s else s


def test_readings_are_shuffled_once_by_device_and_segment(spark):
    k = classify(transform(clean(load_readings(spark, SF_SMALL), validation="report", keep_segment=True)))
    plan = final_plan(k)
    big = [l for l in plan.splitlines() if "Exchange hashpartitioning(device_id" in l and "_seg" in l
           and "FileScan" not in l]
    # the rows: one (device, segment) exchange; the summaries shuffle by device only
    assert len({l.strip() for l in big}) == 1, big
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_device_filter_reaches_the_scan(spark):
    early = classify(transform(clean(load_device_readings(spark, SF_SMALL, "sensor_0003"), validation="report")))
    late = device_readings(classify(transform(clean(load_readings(spark, SF_SMALL), validation="report"))),
                           "sensor_0003")
    plan = final_plan(early)
    scans = [l for l in plan.splitlines() if "FileScan parquet [event_id" in l]
    assert scans and all("EqualTo(user_id,3)" in l for l in scans)    # pushed into the scan
    assert sorted(early.collect()) == sorted(late.collect())          # same rows as filtering last


def test_daily_stats_partial_aggregation(spark):
    d = daily_stats(load_readings(spark, SF_SMALL))
    plan = final_plan(d)
    assert "partial_avg" in plan and "partial_min" in plan
