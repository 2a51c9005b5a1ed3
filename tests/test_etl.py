"""The end-to-end run: enforced contract on the small scale, metrics without extra passes."""
import pytest

from telemetra import ContractViolation
from telemetra.plans import etl
from telemetra.sources.events import load_readings

from conftest import SF_SMALL


def test_run_metrics_and_outputs(spark):
    r = etl.run(load_readings(spark, SF_SMALL), validation="enforce")
    daily = r.daily.collect()
    assert len(daily) > 0
    assert [(x.device_id, x.date) for x in daily] == sorted((x.device_id, x.date) for x in daily)
    m = r.metrics()
    assert m["rows_loaded"] == 1000 and m["rows_dropped"] == m["rows_loaded"] - m["rows_kept"]
    assert m["anomalies"] == r.anomalies.count()


def test_enforced_contract_stops_the_run(spark):
    with pytest.raises(ContractViolation):
        etl.run(load_readings(spark, "/root/testdata/sf0.01"), validation="enforce")


def test_date_range_applies_before_cleaning(spark):
    r = etl.run(load_readings(spark, SF_SMALL), validation="report", start="2024-01-03", end="2024-01-05")
    days = {str(x.date) for x in r.daily.collect()}
    assert days <= {"2024-01-03", "2024-01-04", "2024-01-05"} and days


def test_nothing_stays_persisted_after_a_run(spark):
    before = set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    r = etl.run(load_readings(spark, SF_SMALL), validation="enforce")
    assert r.daily.count() > 0 and r.anomalies.count() == r.metrics()["anomalies"]
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keySet()) <= before
    # all outputs read the stored rows: no ordered scan is left in their plans
    for out in (r.daily, r.anomalies):
        assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
