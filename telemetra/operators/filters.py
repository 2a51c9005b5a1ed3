"""Row selection: preview, date bounds, inclusive date range, one device."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from .. import config as C


def preview(df: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows in ingest order (per-partition top-n, then a merge of n rows each)."""
    order = order or ([C.READING_ID] if C.READING_ID in df.columns else [C.DEVICE, C.TIMESTAMP])
    return df.orderBy(*order).limit(n)


def date_bounds(df: DataFrame) -> DataFrame:
    """First and last calendar day in the data, as one row."""
    return df.agg(F.to_date(F.min(C.TIMESTAMP)).alias("min_date"),
                  F.to_date(F.max(C.TIMESTAMP)).alias("max_date"))


def _as_date(d) -> dt.date:
    if isinstance(d, dt.datetime):
        return d.date()
    if isinstance(d, dt.date):
        return d
    return dt.date.fromisoformat(str(d))


def date_range_filter(df: DataFrame, start=None, end=None) -> DataFrame:
    """Keep readings whose calendar day lies in [start, end], both ends inclusive.

    Written as a half-open timestamp range so it pushes into the scan; on a store partitioned
    by ``date`` the same bounds prune directories.
    """
    cond = F.lit(True)
    if "date" in df.columns and C.TIMESTAMP not in df.columns:
        if start is not None:
            cond = cond & (F.col("date") >= F.lit(_as_date(start)))
        if end is not None:
            cond = cond & (F.col("date") <= F.lit(_as_date(end)))
        return df.filter(cond)
    ts_type = df.schema[C.TIMESTAMP].dataType.simpleString()
    cast = "timestamp_ntz" if ts_type == "timestamp_ntz" else "timestamp"
    if start is not None:
        lo = f"{_as_date(start).isoformat()} 00:00:00"
        cond = cond & (F.col(C.TIMESTAMP) >= F.lit(lo).cast(cast))
    if end is not None:
        hi = f"{(_as_date(end) + dt.timedelta(days=1)).isoformat()} 00:00:00"
        cond = cond & (F.col(C.TIMESTAMP) < F.lit(hi).cast(cast))
    if "date" in df.columns:
        if start is not None:
            cond = cond & (F.col("date") >= F.lit(_as_date(start)))
        if end is not None:
            cond = cond & (F.col("date") <= F.lit(_as_date(end)))
    return df.filter(cond)


def device_readings(df: DataFrame, device: str) -> DataFrame:
    """One device's readings. Every ordered step is keyed by device, so the filter may be applied
    before cleaning with the same result; do so when the frame is persisted (a filter does not
    cross a persisted frame) to keep the other devices out of the shuffle."""
    return df.filter(F.col(C.DEVICE) == device)
