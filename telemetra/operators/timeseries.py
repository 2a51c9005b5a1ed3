"""Per-device time-series steps: ordering, linear gap repair, rolling mean, validity windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from .segments import SEG, add_segment, known_neighbours, neighbour_rows


def sort_readings(df: DataFrame, key: str = C.DEVICE, ts: str = C.TIMESTAMP,
                  tie: str = C.READING_ID) -> DataFrame:
    """Global order by device, time (missing times last), then ingest order.

    A range-partitioned sort: a hot device is spread over several output partitions.
    """
    order = [F.col(key).asc_nulls_last(), F.col(ts).asc_nulls_last()]
    if tie in df.columns:
        order.append(F.col(tie).asc_nulls_last())
    return df.orderBy(*order)


def interpolate_linear(df: DataFrame, cols: list[str] | None = None, key: str = C.DEVICE,
                       ts: str = C.TIMESTAMP, tie: str = C.READING_ID,
                       segment_seconds: int | None = C.DEFAULT_SEGMENT_SECONDS,
                       keep_segment: bool = False, drop_incomplete: bool = False) -> DataFrame:
    """Fill gaps per device by linear interpolation over row positions (not elapsed time).

    Rows are taken in (time, ingest) order, missing times last. A gap between two known values gets
    ``prev + ((next - prev) / (next_pos - prev_pos)) * (pos - prev_pos)``; leading and trailing gaps
    take the nearest known value; a device without any known value stays missing, and so do rows
    without a device. Only columns present in the frame are touched.

    ``drop_incomplete`` then drops every row still missing a value in any column. The test is
    written on the inputs of the repair (a value stays missing only if the row has no device or no
    known value on either side), so the optimizer does not copy the whole formula into the filter.
    """
    cols = [c for c in (cols or C.INTERPOLATED_COLUMNS) if c in df.columns]
    if not cols:
        return df
    order = [ts, tie] if tie in df.columns else [ts]
    d = known_neighbours(df, cols, key=key, order=order, seconds=segment_seconds)
    pos = F.col("_gpos")
    filled = {}
    for c in cols:
        pv, pp = F.col(f"_prev_{c}.v"), F.col(f"_prev_{c}.p")
        nv, np_ = F.col(f"_next_{c}.v"), F.col(f"_next_{c}.p")
        value = (F.when(F.col(c).isNotNull(), F.col(c))
                 .when(pv.isNotNull() & nv.isNotNull(), pv + ((nv - pv) / (np_ - pp)) * (pos - pp))
                 .otherwise(F.coalesce(pv, nv)))
        filled[c] = F.when(F.col(key).isNotNull(), value).alias(c)
    helpers = {"_gpos"} | {f"_prev_{c}" for c in cols} | {f"_next_{c}" for c in cols}
    if not keep_segment:
        helpers.add(SEG)
    out = [filled.get(c, F.col(c)) for c in df.columns if c not in helpers]
    if keep_segment and SEG not in df.columns:
        out.append(F.col(SEG))
    if drop_incomplete:
        keep = F.lit(True)
        for c in df.columns:
            if c == SEG:
                continue
            if c in cols:
                repairable = F.col(key).isNotNull() & (F.col(f"_prev_{c}").isNotNull()
                                                       | F.col(f"_next_{c}").isNotNull())
                keep = keep & (F.col(c).isNotNull() | repairable)
            else:
                keep = keep & F.col(c).isNotNull()
        d = d.filter(keep)
    return d.select(*out)


def rolling_and_validity(df: DataFrame, value: str = C.TEMPERATURE, key: str = C.DEVICE,
                         ts: str = C.TIMESTAMP, tie: str = C.READING_ID,
                         rolling_name: str | None = C.ROLLING, valid_name: str | None = C.VALID_UNTIL,
                         segment_seconds: int | None = C.DEFAULT_SEGMENT_SECONDS) -> DataFrame:
    """3-row rolling mean of ``value`` (NULL until three rows, or if any of them is missing) and
    ``valid_until`` = the device's next timestamp (NULL on its last reading), in one ordered scan."""
    order = [ts, tie] if tie in df.columns else [ts]
    had_seg = SEG in df.columns
    d = neighbour_rows(df, value, key=key, order=order, seconds=segment_seconds,
                       lead_col=ts if valid_name else None)
    extra = []
    if rolling_name:
        extra.append(((F.col("_lag2") + F.col("_lag1") + F.col(value)) / C.ROLLING_WINDOW).alias(rolling_name))
    if valid_name:
        extra.append(F.col("_lead").alias(valid_name))
    drop = {"_lag1", "_lag2", "_lead", rolling_name, valid_name}
    if not had_seg:
        drop.add(SEG)
    keep = [F.col(c) for c in d.columns if c not in drop]
    return d.select(*keep, *extra)


def rolling_mean_3(df: DataFrame, value: str = C.TEMPERATURE, name: str = C.ROLLING, **kw) -> DataFrame:
    return rolling_and_validity(df, value=value, rolling_name=name, valid_name=None, **kw)


def valid_until(df: DataFrame, name: str = C.VALID_UNTIL, **kw) -> DataFrame:
    return rolling_and_validity(df, rolling_name=None, valid_name=name, **kw)


def segment(df: DataFrame, ts: str = C.TIMESTAMP, seconds: int | None = C.DEFAULT_SEGMENT_SECONDS) -> DataFrame:
    """Expose the segment column, for callers chaining several ordered scans on one shuffle."""
    return add_segment(df, ts, seconds)
