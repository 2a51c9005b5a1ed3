"""Queries for the sinks, the warehouse tables and the streaming jobs.

Queries that write (round trips, partitioned stores, streams) put their output under the shared
checkpoint folder (``spark.checkpoint.dir``), each in a new directory, and return the data read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import warehouse as wh
from ..session import scratch_path
from ..sinks import files
from ..sources.readers import read_readings_csv
from ..streaming import jobs
from . import catalog as cat


def dim(spark, sf):
    return wh.dim_devices(cat.transformed(spark, sf))


def fact(spark, sf):
    c = cat.classified(spark, sf)           # one pipeline feeds both the dimension and the fact
    return wh.fact_sensor_readings(c, wh.dim_devices(c))


def q_roundtrip_parquet(spark, sf):
    path = scratch_path(spark, "readings")
    files.write_parquet(cat.classified(spark, sf), path)
    return spark.read.parquet(path)


def q_roundtrip_csv(spark, sf):
    """CSV sink (with ``date``), then the CSV reader: every value and microsecond comes back."""
    path = scratch_path(spark, "readings-csv")
    files.write_csv(cat.classified(spark, sf), path)
    return read_readings_csv(spark, path, with_reading_id=False).select(
        *C.READING_COLUMNS, F.col(C.READING_ID).cast("long").alias(C.READING_ID), F.col(C.DATE).cast("date").alias(C.DATE))


def q_export_csv(spark, sf):
    """CSV export without ``date``: its columns are those of the frame."""
    path = scratch_path(spark, "export-csv")
    files.write_csv(cat.classified(spark, sf), path, include_date=False)
    back = read_readings_csv(spark, path, with_reading_id=False)
    return back.select(*[F.col(c).cast("long" if c == C.READING_ID else "boolean" if c == C.IS_ANOMALY else "string" if c == C.ANOMALY_TYPE else back.schema[c].dataType)
                         .alias(c) for c in back.columns if c in [*C.READING_COLUMNS, C.READING_ID, C.DATE, C.IS_ANOMALY, C.ANOMALY_TYPE]])


def defective(spark, sf):
    """A dimension with fixed defects, and the fact built on it: every tenth device is missing, another tenth is listed twice."""
    c = cat.classified(spark, sf)
    d = wh.dim_devices(c)
    lacking = d.filter(F.col("device_key") % 10 != 3)
    return lacking.unionByName(lacking.filter(F.col("device_key") % 10 == 5)), wh.fact_sensor_readings(c, lacking)


def q_dim_devices(spark, sf):
    return dim(spark, sf)


def q_fact_sensor_readings(spark, sf):
    return fact(spark, sf)


def q_constraint_audit(spark, sf):
    return wh.constraint_audit(*defective(spark, sf))


def q_orphan_readings(spark, sf):
    d, f = defective(spark, sf)
    return wh.orphan_readings(f, d)


def q_fact_by_year(spark, sf):
    path = scratch_path(spark, "fact-by-year")
    wh.write_fact_by_year(fact(spark, sf), path)
    return wh.year_summary(spark.read.parquet(path))


def q_fact_layout(spark, sf):
    path = scratch_path(spark, "fact-layout")
    wh.write_layout(fact(spark, sf), path)
    return spark.read.parquet(path)


def q_asof_reading(spark, sf):
    # the reading valid at t (timestamp <= t < valid_until) is the last cleaned reading at or before t
    c = cat.cleaned(spark, sf, keep_segment=False)
    return wh.asof_reading(c, wh.daily_probes(c))


def q_reporting_gaps(spark, sf):
    t = cat.transformed(spark, sf)
    return wh.reporting_gaps(t, wh.dim_devices(t))


QUERIES = {
    "roundtrip_parquet": q_roundtrip_parquet,
    "roundtrip_csv": q_roundtrip_csv,
    "export_csv": q_export_csv,
    "dim_devices": q_dim_devices,
    "fact_sensor_readings": q_fact_sensor_readings,
    "constraint_audit": q_constraint_audit,
    "orphan_readings": q_orphan_readings,
    "fact_by_year": q_fact_by_year,
    "fact_layout": q_fact_layout,
    "asof_reading": q_asof_reading,
    "reporting_gaps": q_reporting_gaps,
}
QUERIES.update(jobs.QUERIES)
