"""A store of processed readings that takes late files without a full run.

``root`` holds the readings as loaded (``raw``, by load and date), what the run makes of them (``processed``, by date) and one row a device and day (``days``) that says
whether the day is an *anchor*: it has a known value of every repaired column and enough complete readings for the rolling window. Nothing that a run computes
reaches across an anchor: repair looks to the nearest known values, the rolling mean two kept readings back, the validity window one ahead.

So a late reading changes its device from the last anchor before its day to the next one after it, both included, and no other day. These days are computed
anew from the readings between the anchors around them, the carry that the full run would have; where there is no anchor, from the
device's first or to its last reading. Only dates that hold such days are rewritten, and in them other devices' rows are copied.

A load has a name and can be repeated after a failure at any point: its raw files replace themselves, and each later step starts from raw.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import config as C
from ..functions.columns import nan_to_null
from ..operators.anomaly import classify
from ..operators.cleaning import clean
from ..operators.derive import transform
from ..operators.segments import released
from ..session import scratch_path
from ..sinks.files import with_partition_date, write_parquet

LOAD = "load"


@dataclass(frozen=True)
class Change:
    """What a load changed: days recomputed (device, date), read as context, and the dates whose files were replaced."""
    recomputed: DataFrame
    context: DataFrame
    dates: list[dt.date]


def _process(readings: DataFrame, path: str) -> DataFrame:
    """The run over ``readings``, stored once."""
    with released():
        rows = with_partition_date(classify(transform(clean(readings, validation="report", keep_segment=True))))
        rows.write.mode("overwrite").parquet(path)
    return readings.sparkSession.read.schema(rows.schema).parquet(path)


def _write_raw(readings: DataFrame, root: str, load: str) -> None:
    """The readings of one load; writing it again replaces it."""
    rows = with_partition_date(readings).withColumn(LOAD, F.lit(load))
    (rows.repartitionByRange(C.DATE, C.DEVICE, C.TIMESTAMP).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(LOAD, C.DATE).parquet(f"{root}/raw"))


def raw(spark: SparkSession, root: str) -> DataFrame:
    """Everything loaded so far, with ``load`` and ``date``."""
    return spark.read.option("basePath", f"{root}/raw").parquet(f"{root}/raw").withColumn(LOAD, F.col(LOAD).cast("string")).withColumn(C.DATE, F.col(C.DATE).cast("date"))


def processed(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/processed").withColumn(C.DATE, F.col(C.DATE).cast("date"))


def _days(rows: DataFrame) -> DataFrame:
    """(device, date, anchor) of readings with a date."""
    there = lambda c: nan_to_null(F.col(c)).isNotNull() if c in C.MEASURE_COLUMNS else F.col(c).isNotNull()
    whole = F.lit(True)
    for c in rows.columns:
        if c not in (LOAD, C.DATE):
            whole = whole & there(c)
    repaired = [c for c in C.INTERPOLATED_COLUMNS if c in rows.columns]
    known = [F.count_if(there(c)) > 0 for c in repaired]
    anchor = F.count_if(whole) >= C.ROLLING_WINDOW - 1
    for k in known:
        anchor = anchor & k
    return rows.filter(F.col(C.DEVICE).isNotNull() & F.col(C.DATE).isNotNull()).groupBy(C.DEVICE, C.DATE).agg(anchor.alias("anchor"))


def build(readings: DataFrame, root: str, load: str = "first") -> None:
    """The first load: a full run into an empty ``root``. ``readings`` need a ``reading_id``."""
    spark = readings.sparkSession
    if C.READING_ID not in readings.columns:
        raise ValueError("readings need a reading_id, which keeps ties in order over loads")
    _write_raw(readings, root, load)
    rows = raw(spark, root)
    write_parquet(_process(rows.drop(LOAD, C.DATE), scratch_path(spark, "processed")), f"{root}/processed", mode="overwrite")
    write_parquet(_days(rows), f"{root}/days", mode="overwrite")


def reach(days: DataFrame, changed: DataFrame) -> DataFrame:
    """For each changed (device, date): ``lo`` and ``hi``, the anchors around it, and ``lo2`` and ``hi2``, the ones beyond those; NULL where there is
    none. ``days``: (device, date, anchor). A window a device over its days."""
    marks = (days.join(changed.select(C.DEVICE).distinct(), C.DEVICE, "left_semi").withColumn("changed", F.lit(False))
             .unionByName(changed.select(C.DEVICE, C.DATE, F.lit(False).alias("anchor"), F.lit(True).alias("changed")))
             .groupBy(C.DEVICE, C.DATE).agg(F.max("anchor").alias("anchor"), F.max("changed").alias("changed")))

    def around(d: DataFrame, order: Column, near: str, far: str) -> DataFrame:
        w = Window.partitionBy(C.DEVICE).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        d = d.withColumn(near, F.last(F.when(F.col("anchor"), F.col(C.DATE)), ignorenulls=True).over(w))
        # a struct is there even if its second field is not
        beyond = F.last(F.when(F.col("anchor"), F.struct(F.col(near).alias("d"))), ignorenulls=True).over(w)
        return d.withColumn(far, beyond["d"])

    both = around(around(marks, F.col(C.DATE).asc(), "lo", "lo2"), F.col(C.DATE).desc(), "hi", "hi2")
    return both.filter("changed").select(C.DEVICE, C.DATE, "lo", "lo2", "hi", "hi2")


def _between(days: DataFrame, ranges: DataFrame, lo: str, hi: str) -> DataFrame:
    """The (device, date) of ``days`` within a range of its device."""
    r = ranges.select(F.col(C.DEVICE).alias("_d"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi")).distinct()
    inside = (F.col("_lo").isNull() | (F.col(C.DATE) >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col(C.DATE) <= F.col("_hi")))
    return days.join(r, (F.col(C.DEVICE) == F.col("_d")) & inside, "left_semi").select(C.DEVICE, C.DATE).distinct()


def _dates(days: DataFrame) -> list[dt.date]:
    """Their dates, of which a calendar holds few."""
    return sorted(r[0] for r in days.select(C.DATE).distinct().collect())


def add_late(spark: SparkSession, root: str, late: DataFrame, load: str) -> Change:
    """Take the readings of one more load into the store, of whatever days. The store is then that of a full run over all loads.

    Readings without a device or a time are kept in ``raw`` and take no part, as in a full run. An empty load changes nothing. A
    ``load`` given again is replaced, not added to; its readings must then be the same.
    """
    begun = f"{root}/loads"
    spark.createDataFrame([], f"{LOAD} string").write.mode("ignore").parquet(begun)
    again = not spark.read.schema(f"{LOAD} string").parquet(begun).filter(F.col(LOAD) == load).isEmpty()
    spark.createDataFrame([(load,)], f"{LOAD} string").coalesce(1).write.mode("append").parquet(begun)
    _write_raw(late, root, load)
    rows = raw(spark, root)
    mine = rows.filter(F.col(LOAD) == load)
    changed = _days(mine).select(C.DEVICE, C.DATE)
    scratch = scratch_path(spark, "late")
    # anchors are those of the other loads, so that the reach is never too short; a load that was begun before may be among the stored ones
    days = _days(rows.filter(F.col(LOAD) != load)) if again else spark.read.parquet(f"{root}/days").select(C.DEVICE, F.col(C.DATE).cast("date").alias(C.DATE), "anchor")
    reach(days, changed).write.parquet(f"{scratch}/reach")
    ranges = spark.read.parquet(f"{scratch}/reach")
    all_days = days.select(C.DEVICE, C.DATE).unionByName(changed).join(changed.select(C.DEVICE).distinct(), C.DEVICE, "left_semi").distinct()
    all_days.write.parquet(f"{scratch}/all")
    all_days = spark.read.parquet(f"{scratch}/all")
    _between(all_days, ranges, "lo", "hi").write.parquet(f"{scratch}/recomputed")
    _between(all_days, ranges, "lo2", "hi2").write.parquet(f"{scratch}/context")
    recomputed, context = spark.read.parquet(f"{scratch}/recomputed"), spark.read.parquet(f"{scratch}/context")
    dates, read = _dates(recomputed), _dates(context)
    if dates:
        near = rows.filter(F.col(C.DATE).isin(read)).join(context, [C.DEVICE, C.DATE], "left_semi").select(*[c for c in rows.columns if c not in (LOAD, C.DATE)])
        new = _process(near, f"{scratch}/slice").join(recomputed, [C.DEVICE, C.DATE], "left_semi")
        old = processed(spark, root).filter(F.col(C.DATE).isin(dates)).join(recomputed, [C.DEVICE, C.DATE], "left_anti")
        new.unionByName(old).write.parquet(f"{scratch}/dates")          # read in full before their files are replaced
        write_parquet(spark.read.parquet(f"{scratch}/dates"), f"{root}/processed", overwrite_touched_partitions=True)
        touched = _dates(changed)
        write_parquet(_days(rows.filter(F.col(C.DATE).isin(touched))), f"{root}/days", overwrite_touched_partitions=True)
    return Change(recomputed, context, dates)
