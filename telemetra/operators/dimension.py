"""Loads into a device dimension that already has keys.

A surrogate key belongs to a device for good: facts that are stored point at it. A load leaves the keys of known devices as they are and gives new ones
the numbers after the largest key. Each load publishes a whole new version of the (small) table; readers see the last one that was published.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import config as C
from ..functions.columns import epoch_seconds
from ..session import shared_dir
from .warehouse import HIGH_FREQUENCY_MAX_SECONDS

_ROW_BITS = 33      # monotonically_increasing_id keeps the row number in its lower 33 bits
LOG = "version long, path string"


class VersionedTable:
    """A table whose versions are written beside each other under ``root`` and named in a log there.

    A version counts once its row is in the log, which is written after the data: a load that fails half-way leaves the last version as it was, and
    what it wrote is never read. Two loads that publish at once are found (``read`` raises), not merged.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        spark.createDataFrame([], LOG).write.mode("ignore").parquet(f"{self.root}/log")

    def versions(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.root}/log")

    def _paths(self, version: int | None) -> tuple[int, str] | None:
        last = self.versions() if version is None else self.versions().filter(F.col("version") == version)
        found = last.groupBy("version").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n")).orderBy(F.col("version").desc()).first()
        if found is None:
            return None
        if found["n"] > 1:
            raise ValueError(f"version {found['version']} of {self.root} was published {found['n']} times; only one load may run at a time")
        return found["version"], found["path"]

    def version(self) -> int:
        """The last version; 0 before the first."""
        found = self._paths(None)
        return found[0] if found else 0

    def read(self, version: int | None = None) -> DataFrame | None:
        """The last version, or an earlier one; None where there is none."""
        found = self._paths(version)
        return self.spark.read.parquet(f"{self.root}/{found[1]}") if found else None

    def publish(self, df: DataFrame) -> int:
        number, path = self.version() + 1, f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{path}")
        self.spark.createDataFrame([(number, path)], LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        return number


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """``df`` with dense numbers from ``start`` in ``order``: rows are dealt by ranges, numbered in their task and shifted by the sizes of the tasks
    before (one row a task). The dealt rows are checkpointed, so that numbers stay."""
    shared_dir(df.sparkSession)
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    dealt = dealt.withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.lit(start)
    return dealt.join(shift, "_part").withColumn(name, place).drop("_mid", "_part", "_before")


def merge_devices(known: DataFrame | None, readings: DataFrame) -> DataFrame:
    """The dimension after a load: ``known`` (None before the first load) and the devices of ``readings``.

    Known devices keep their key; first and last time, number of readings and what follows from them take the load in. New ones are numbered in the
    order of their ids after the largest key. A reading without a device belongs to none; one without a time does not count. Loading the
    same readings twice counts them twice: drop repeats first.
    """
    seconds = lambda c: epoch_seconds(c, readings.schema[C.TIMESTAMP].dataType)
    seen = (readings.filter(F.col(C.DEVICE).isNotNull()).groupBy(C.DEVICE)
            .agg(F.min(C.TIMESTAMP).alias("_first"), F.max(C.TIMESTAMP).alias("_last"), F.count(C.TIMESTAMP).alias("_n")))
    if known is None:
        both = seen.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("device_key", "int"), ("model", "string"), ("location", "string"))],
                           *[F.lit(None).cast(readings.schema[C.TIMESTAMP].dataType).alias(c) for c in ("created_at", "last_seen")], F.lit(None).cast("long").alias("n_readings"))
        largest = 0
    else:
        both = known.select("device_key", C.DEVICE, "model", "location", "created_at", "last_seen", "n_readings").join(seen, C.DEVICE, "full_outer")
        largest = known.agg(F.max("device_key")).first()[0] or 0
    new = numbered(both.filter(F.col("device_key").isNull()), [F.col(C.DEVICE).asc()], "_key", largest + 1)
    old = both.filter(F.col("device_key").isNotNull()).withColumn("_key", F.col("device_key").cast("long"))
    first, last, n = F.least("created_at", "_first"), F.greatest("last_seen", "_last"), F.coalesce("n_readings", F.lit(0)) + F.coalesce("_n", F.lit(0))
    d = old.unionByName(new).select(F.col("_key").cast("int").alias("device_key"), C.DEVICE, "model", "location", first.alias("created_at"), last.alias("last_seen"), n.alias("n_readings"))
    interval = F.when(F.col("n_readings") > 1, F.floor((seconds("last_seen") - seconds("created_at")) / (F.col("n_readings") - 1))).cast("int")
    category = F.when(interval.isNull(), "On-Event").when(interval <= HIGH_FREQUENCY_MAX_SECONDS, "High-Frequency").otherwise("Periodic")
    return d.select("*", interval.alias("expected_interval_seconds"), category.alias("sensor_category"))


def load_devices(table: VersionedTable, readings: DataFrame) -> DataFrame:
    """One load into the stored dimension; returns its new version."""
    table.publish(merge_devices(table.read(), readings))
    return table.read()
