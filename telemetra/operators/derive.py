"""Derived reading columns: Fahrenheit, hour of day, rolling mean, validity end."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..functions.columns import fahrenheit, hour_of_day
from .segments import SEG
from .timeseries import rolling_and_validity


def transform(df: DataFrame, segment_seconds: int | None = C.DEFAULT_SEGMENT_SECONDS) -> DataFrame:
    """Add ``temperature_fahrenheit``, ``hour_of_day``, ``temp_rolling_avg_3`` and ``valid_until``.

    Rolling mean and validity run over the rows as they are now (after cleaning), per device in
    time order. If the frame still carries the segment column from ``clean(keep_segment=True)``
    the ordered scan reuses that shuffle.
    """
    d = df.select("*", fahrenheit(C.TEMPERATURE).alias(C.FAHRENHEIT),
                  hour_of_day(C.TIMESTAMP).alias(C.HOUR))
    d = rolling_and_validity(d, segment_seconds=segment_seconds)
    return d.drop(SEG) if SEG in d.columns else d


def with_date(df: DataFrame, name: str = C.DATE) -> DataFrame:
    return df.withColumn(name, F.to_date(C.TIMESTAMP))
