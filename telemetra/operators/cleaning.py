"""Cleaning: order, repair gaps, drop what cannot be repaired, check the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..functions.columns import missing_to_null, nan_to_null
from .quality import validate
from .segments import SEG
from .timeseries import interpolate_linear


def with_reading_id(df: DataFrame) -> DataFrame:
    """Give frames without one an ingest-order row id (the tie-break for equal timestamps)."""
    if C.READING_ID in df.columns:
        return df
    return df.withColumn(C.READING_ID, F.monotonically_increasing_id())


def normalise(df: DataFrame) -> DataFrame:
    """Coerce reading columns to their types; NaN counts as missing, text that is no timestamp fails."""
    out = []
    for c in df.columns:
        if c == C.TIMESTAMP and df.schema[c].dataType.simpleString() == "string":
            value = missing_to_null(c).try_cast("timestamp_ntz")
            out.append(F.when(missing_to_null(c).isNotNull() & value.isNull(), F.raise_error(F.concat(
                F.lit(f"unparsable timestamp in column {c}: "), F.col(c)))).otherwise(value).alias(c))
        elif c in C.MEASURE_COLUMNS:
            out.append(nan_to_null(F.col(c).cast("double")).alias(c))
        elif c == C.DEVICE and df.schema[c].dataType.simpleString() != "string":
            out.append(F.col(c).cast("string").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def clean(df: DataFrame, validation: str = "enforce", keep_segment: bool = False,
          segment_seconds: int | None = C.DEFAULT_SEGMENT_SECONDS) -> DataFrame:
    """Interpolate per device → drop incomplete rows → validate.

    ``validation``: ``enforce`` (raise on any contract failure; the check re-reads the persisted
    windowed rows of the interpolation, not the source), ``report``/``off`` (keep all rows),
    ``quarantine`` (keep passing rows). ``keep_segment`` leaves the internal segment column on the
    frame so that ``transform`` can reuse the same shuffle.
    """
    missing = [c for c in (C.TIMESTAMP, C.DEVICE, C.TEMPERATURE, C.HUMIDITY) if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    d = with_reading_id(normalise(df))
    d = interpolate_linear(d, keep_segment=True, segment_seconds=segment_seconds, drop_incomplete=True)
    d = validate(d, validation)
    if not keep_segment:
        d = d.drop(SEG)
    return d


def dropped_count(df: DataFrame, segment_seconds: int | None = C.DEFAULT_SEGMENT_SECONDS) -> DataFrame:
    """Rows before and after interpolation + drop, and the difference, as one row."""
    d = with_reading_id(normalise(df))
    repaired = interpolate_linear(d, segment_seconds=segment_seconds)
    complete = F.lit(True)
    for c in repaired.columns:
        complete = complete & F.col(c).isNotNull()
    return repaired.agg(F.count(F.lit(1)).alias("rows_loaded"),
                        F.count_if(complete).alias("rows_kept")) \
        .withColumn("rows_dropped", F.col("rows_loaded") - F.col("rows_kept"))
