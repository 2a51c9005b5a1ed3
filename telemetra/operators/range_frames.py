"""Rolling aggregates over a stretch of time, without a device's history in one task.

For a window of W each row needs every reading of its device in [t - W, t]: the frame of SQL's ``RANGE BETWEEN INTERVAL W PRECEDING AND
CURRENT ROW``. Time is cut into panes of W / 2**level. What a row at t in pane b needs falls into three parts:

* the readings of its own pane up to t;
* the readings of pane b - 2**level that are not yet W old. Every reading is sent along a second time (its value only) to the pane in which it
  leaves the window, at the time when it does, so these are the readings that leave the pane's window at t or later;
* whole panes between, from one summary row a pane.

The rows are shuffled once, by (device, pane). Level is chosen per device so that its fullest pane holds about the target number of rows: a quiet device has
one pane a window, a hot or bursty one up to 1024. Only rows of one and the same instant cannot be parted. Minimum and maximum need no
undoing, and sums are never subtracted, so no digits are lost.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from .. import config as C
from ..functions.columns import epoch_micros, nan_to_null

MAX_LEVEL = 10
LEVEL_STEP = 2


def _levels(micros: int) -> list[int]:
    """Levels at which the window is a whole number of panes of whole microseconds."""
    return [k for k in range(0, MAX_LEVEL + 1, LEVEL_STEP) if micros % (1 << k) == 0]


def _pane(t, width):
    """Number of the pane of a time; exact, also before 1970."""
    return F.call_function("div", t - F.pmod(t, width), width)


def pane_levels(times: DataFrame, key: str, micros: int, target_rows: int) -> DataFrame:
    """(key, _level): per key the coarsest level whose fullest pane holds at most ``target_rows`` rows, else the finest.
    ``times``: (key, _t). Rows are counted once, by the finest panes and combined map-side; coarser panes add those up."""
    levels = _levels(micros)
    finest = levels[-1]
    fine = times.groupBy(key, _pane(F.col("_t"), F.lit(micros >> finest)).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    each = fine.select(key, "_b", "_n", F.explode(F.array(*[F.lit(k) for k in levels])).alias("_level"))
    panes = each.groupBy(key, "_level", F.call_function("shiftright", F.col("_b"), F.lit(finest) - F.col("_level")).alias("_b")).agg(F.sum("_n").alias("_n"))
    fullest = panes.groupBy(key, "_level").agg(F.max("_n").alias("_n"))
    fits = fullest.filter((F.col("_n") <= target_rows) | (F.col("_level") == finest))
    return fits.groupBy(key).agg(F.min("_level").alias("_level"))


def rolling_range(df: DataFrame, value: str = C.TEMPERATURE, window: dt.timedelta = dt.timedelta(hours=6), name: str = "rolling",
                  key: str = C.DEVICE, ts: str = C.TIMESTAMP, target_rows: int | None = None) -> DataFrame:
    """``df`` with ``<name>_count``, ``_mean``, ``_min`` and ``_max`` of ``value`` over the readings of the same device from ``window`` before each row
    to its time, both included, and with them all readings of that very time.

    NULL and NaN values are missing: they do not count, and a window without a value has count 0 and no mean. Rows without a
    device or a time come back with NULLs. Repeated rows count each.
    """
    micros = int(window / dt.timedelta(microseconds=1))
    if micros <= 0:
        raise ValueError("the window must be longer than nothing")
    names = [f"{name}_{k}" for k in ("count", "mean", "min", "max")]
    placed = F.col(key).isNotNull() & F.col(ts).isNotNull()
    number = nan_to_null(F.col(value).cast("double"))
    rows = df.filter(placed).withColumn("_t", epoch_micros(ts, df.schema[ts].dataType)).withColumn("_v", number)
    slim = rows.select(key, "_t", "_v")
    level = pane_levels(slim.select(key, "_t"), key, micros, target_rows or C.TARGET_SEGMENT_ROWS)

    def cut(d: DataFrame) -> DataFrame:
        d = d.join(level, key, "left").withColumn("_level", F.coalesce("_level", F.lit(0)))
        return d.withColumn("_b", _pane(F.col("_t"), F.call_function("shiftright", F.lit(micros).cast("long"), F.col("_level"))))

    here = cut(rows).withColumn("_own", F.lit(True))
    panes_a_window = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_level"))
    leaving = cut(slim.filter("_v IS NOT NULL")).select(key, (F.col("_t") + micros).alias("_t"), (F.col("_b") + panes_a_window).alias("_b"), F.col("_v").alias("_gone"))
    both = here.unionByName(leaving, allowMissingColumns=True)
    by = Window.partitionBy(key, "_b")
    up = by.orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = by.orderBy(F.col("_t").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    parts = [(f, f"_{o}{k}", v, w) for o, v, w in (("o", "_v", up), ("l", "_gone", down)) for k, f in (("n", F.count), ("s", F.sum), ("i", F.min), ("a", F.max))]
    both = both.select("*", *[f(v).over(w).alias(out) for f, out, v, w in parts]).filter("_own")

    summary = cut(slim.filter("_v IS NOT NULL")).groupBy(key, "_level", "_b").agg(F.count("_v").alias("_n"), F.sum("_v").alias("_s"), F.min("_v").alias("_i"), F.max("_v").alias("_a"))
    # a pane without a value has rows that look back all the same
    asked = cut(slim).select(key, "_level", "_b").distinct()
    panes = asked.join(summary, [key, "_level", "_b"], "left")
    between = None
    for k in _levels(micros)[1:]:
        w = Window.partitionBy(key).orderBy("_b").rangeBetween(1 - (1 << k), -1)
        one = panes.filter(F.col("_level") == k).select(key, "_b", F.sum("_n").over(w).alias("_mn"), F.sum("_s").over(w).alias("_ms"), F.min("_i").over(w).alias("_mi"), F.max("_a").over(w).alias("_ma"))
        between = one if between is None else between.unionByName(one)
    if between is None:
        both = both.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("_mn", "long"), ("_ms", "double"), ("_mi", "double"), ("_ma", "double"))])
    else:
        both = both.join(between, [key, "_b"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    count = zero("_on") + zero("_ln") + zero("_mn")
    total = zero("_os") + zero("_ls") + zero("_ms")
    out = both.select(*[F.col(c) for c in df.columns], count.cast("long").alias(names[0]), F.when(count > 0, total / count).alias(names[1]),
                      F.least("_oi", "_li", "_mi").alias(names[2]), F.greatest("_oa", "_la", "_ma").alias(names[3]))
    rest = df.filter(~placed).select("*", *[F.lit(None).cast("long" if n == names[0] else "double").alias(n) for n in names])
    return out.unionByName(rest)
