"""Inputs, hold-out rule and stored intermediate tables of the text operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path, shared_dir, ship_package

#: Arrow batches of bounded size, whatever the lengths of the texts (runtime settings; no result depends on them).
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
           "spark.sql.optimizer.windowGroupLimitThreshold": "4096"}      # first few thousand of a group: cut before the shuffle
#: Whether an execution's shuffle files are removed when it ends, not when the driver's garbage collection comes upon them (Spark 4.1).
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tuned(spark: SparkSession) -> SparkSession:
    for k, v in BATCHES.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    shared_dir(spark)
    ship_package(spark)
    return spark


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf}/{name}.parquet")


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether the document is held out: crc32 of its id as text has this remainder. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def learnable(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether labels of the document may be learned: its id is known and it is not held out."""
    return F.col(doc_id).isNotNull() & ~held_out(doc_id, modulus, remainder)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the cluster's shared folder and read it back: lineage is cut, and a lost
    executor costs nothing that was stored. The files of the write's shuffles go when it ends, as nothing reads them again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


class Bitmap:
    """A set of 64-bit numbers in a bitmap of fixed size: never misses a member, may let others through."""

    BITS = 1 << 23                       # 1 MB, whatever the number of members

    def __init__(self, words: np.ndarray, at: np.ndarray):
        self.words = np.zeros(self.BITS // 64, np.int64)
        self.words[at] = words

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = h % self.BITS
        return (self.words[slot >> 6] >> (slot & 63)) & 1 == 1


def fixed_bitmap(members: DataFrame) -> Bitmap:
    """The bitmap of the one column ``h``. Spark ORs the bits together; at most 131,072 words reach the driver."""
    slot = F.pmod(F.col("h"), F.lit(Bitmap.BITS))
    words = members.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(
        f"shiftleft(1L, cast(pmod(h, {Bitmap.BITS}) & 63 as int))")).alias("word")).toPandas()
    return Bitmap(words["word"].to_numpy(np.int64), words["at"].to_numpy(np.int64))


def keep_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` (doc_id, text_hash, kept; a row for each of ``docs``) keeps, all columns as they were.

    Rows are matched by id and text, so ids that are null or used twice for different texts are told apart; of rows that agree in
    both, one stays where any is kept. Rows outside a bitmap of what is dropped or repeated pass as they are; only the others cross the network,
    repeated ones combined beforehand. Beyond some ten million dropped rows the bitmap lets all through to the shuffle.
    """
    votes = verdicts.groupBy(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).agg(F.count(F.lit(1)).alias("__n"), F.max("kept").alias("__k"))
    changed = stored(votes.where("__n > 1 or not __k"), "changed")
    bits = fixed_bitmap(changed.select(F.xxhash64("__d", "__h").alias("h")))
    flags = docs.sparkSession.createDataFrame([(i, int(w)) for i, w in enumerate(bits.words.tolist()) if w], "__at long, __word long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").alias("__id"),
                       F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("__t"))
    rows = rows.withColumn("__slot", F.pmod(F.xxhash64("__id", "__t"), F.lit(Bitmap.BITS)))
    rows = rows.join(F.broadcast(flags), F.shiftright("__slot", 6) == F.col("__at"), "left")                # at most 131,072 rows
    maybe = F.coalesce(F.expr("shiftrightunsigned(__word, cast(__slot & 63 as int)) & 1") == 1, F.lit(False))
    one = rows.where(maybe).groupBy("__id", "__t").agg(F.any_value("__row").alias("__row"))
    dropped = changed.where("not __k")
    left = one.join(dropped, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__h")), "left_anti")
    return rows.where(~maybe).select("__row.*").unionByName(left.select("__row.*"))
