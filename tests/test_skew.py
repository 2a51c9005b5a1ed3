"""A device that owns most of the rows is cut into many segments, and results stay exact."""
import datetime as dt
import random

from pyspark.sql import Window, functions as F

from telemetra import config as C
from telemetra.operators import segments
from telemetra.operators.timeseries import interpolate_linear, rolling_and_validity

from test_cleaning import model_interpolate

SCHEMA = ("timestamp timestamp_ntz, device_id string, temperature_celsius double, humidity_percent double, "
          "pressure_hpa double, battery_level_percent double, reading_id long")


def skewed(spark, hot_rows=600, cold_devices=20):
    rng = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows, hot_vals = [], []
    for i in range(hot_rows):
        v = None if rng.random() < 0.3 else float(i % 17)
        hot_vals.append(v)
        rows.append((base + dt.timedelta(seconds=10 * i), "hot", v, 1.0, 1.0, 1.0, i))
    for d in range(cold_devices):
        rows.append((base + dt.timedelta(hours=d), f"cold{d}", float(d), 1.0, 1.0, 1.0, 10_000 + d))
    return spark.createDataFrame(rows, SCHEMA), hot_vals


def test_hot_device_gets_many_bounded_segments(spark, monkeypatch):
    monkeypatch.setattr(C, "TARGET_SEGMENT_ROWS", 25)
    df, hot_vals = skewed(spark)
    seg = segments.add_segment(df, seconds=None)
    sizes = seg.groupBy("device_id", segments.SEG).count()
    hot = sizes.filter("device_id = 'hot'")
    assert hot.count() >= 20                                   # ~600 / 25 segments
    assert hot.agg(F.max("count")).first()[0] <= 40            # no segment near the device's size
    assert sizes.filter("device_id != 'hot'").count() == 20    # one segment per sparse device

    got = [r[C.TEMPERATURE] for r in interpolate_linear(df, segment_seconds=None)
           .filter("device_id = 'hot'").orderBy("timestamp").collect()]
    assert got == model_interpolate(hot_vals)

    roll = rolling_and_validity(df.filter("device_id = 'hot' AND temperature_celsius IS NOT NULL"),
                                segment_seconds=None).orderBy("timestamp").collect()
    temps = [r[C.TEMPERATURE] for r in roll]
    exp = [None, None] + [(temps[i - 2] + temps[i - 1] + temps[i]) / 3 for i in range(2, len(temps))]
    assert [r[C.ROLLING] for r in roll] == exp
    assert [r[C.VALID_UNTIL] for r in roll] == [r.timestamp for r in roll[1:]] + [None]


def test_bursts_are_cut_by_their_rows(spark, monkeypatch):
    """96 % of the readings over a year, 4 % in its last minute: no segment holds over twice the target; order holds."""
    monkeypatch.setattr(C, "TARGET_SEGMENT_ROWS", 100)
    micros = F.when(F.col("id") < 19_200, F.col("id") * 1_642_000_000).otherwise(31_536_000_000_000 - (20_000 - F.col("id")) * 75_000)
    df = spark.range(20_000).select(F.lit("hot").alias("device_id"), F.col("id").alias("reading_id"),
                                    F.timestamp_micros(micros).cast("timestamp_ntz").alias("timestamp"))
    seg = segments.add_segment(df, seconds=None)
    sizes = [r["count"] for r in seg.groupBy(segments.SEG).count().collect()]
    assert max(sizes) <= 200 and 200 <= len(sizes) <= 512
    assert seg.groupBy(segments.SEG).agg(F.min("reading_id").alias("a"), F.max("reading_id").alias("b"), F.count("*").alias("n")) \
        .filter("b - a + 1 != n").count() == 0
    assert seg.orderBy("timestamp").select(F.lag(segments.SEG).over(Window.orderBy("timestamp")).alias("p"), segments.SEG) \
        .filter(f"p > {segments.SEG}").count() == 0


def test_more_segments_than_quantiles_and_odd_times(spark, monkeypatch):
    """Beyond the number of quantiles segments are cut evenly in time; one time for all rows, and rows without one, have a place."""
    monkeypatch.setattr(C, "TARGET_SEGMENT_ROWS", 5)
    at = F.timestamp_micros(F.col("id") * 1_000_000).cast("timestamp_ntz")
    even = spark.range(10_000).select(F.lit("d").alias("device_id"), F.col("id").alias("reading_id"), at.alias("timestamp"))
    same = spark.range(30).select(F.lit("s").alias("device_id"), F.col("id").alias("reading_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("timestamp"))
    none = spark.range(3).select(F.lit("d").alias("device_id"), (F.col("id") + 20_000).alias("reading_id"), F.lit(None).cast("timestamp_ntz").alias("timestamp"))
    seg = segments.add_segment(even.unionByName(same).unionByName(none), seconds=None).persist()
    sizes = [r["count"] for r in seg.filter("device_id = 'd' AND timestamp IS NOT NULL").groupBy(segments.SEG).count().collect()]
    assert sum(sizes) == 10_000 and max(sizes) <= 15
    assert seg.filter("device_id = 's'").select(segments.SEG).distinct().count() == 1
    assert seg.filter(f"timestamp IS NULL AND {segments.SEG} < {segments.LAST_SEGMENT}").count() == 0
    seg.unpersist()
