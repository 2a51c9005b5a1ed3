"""Column expressions (all JVM-side, codegen-friendly) used across the library."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .. import config as C


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_to_null(c: str | Column, tokens=C.MISSING_TOKENS) -> Column:
    """Text that is one of the missing-value tokens becomes NULL; other text is kept."""
    c = col(c)
    return F.when(~c.isin(list(tokens)), c)


def nan_to_null(c: str | Column) -> Column:
    """NaN counts as missing everywhere (comparisons and averages would otherwise see it)."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def fahrenheit(celsius: str | Column) -> Column:
    return col(celsius) * 9 / 5 + 32


def hour_of_day(ts: str | Column) -> Column:
    return F.hour(col(ts))


def is_true(cond: Column) -> Column:
    """A comparison with a missing value counts as False, never NULL."""
    return F.coalesce(cond, F.lit(False))


def epoch_seconds(ts: str | Column, dtype: T.DataType) -> Column:
    """Whole seconds since 1970-01-01 of a timestamp, monotone in the timestamp.

    A TIMESTAMP_NTZ value is read as wall-clock time, with no session time zone involved, so the
    result never goes backwards across a daylight-saving change.
    """
    c = col(ts)
    if isinstance(dtype, T.TimestampNTZType):
        return (F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long") * 86400
                + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c))
    return F.unix_seconds(c.cast("timestamp"))


def epoch_micros(ts: str | Column, dtype: T.DataType) -> Column:
    """Microseconds since 1970-01-01 of a timestamp, monotone in the timestamp, as ``epoch_seconds``."""
    c = col(ts)
    if isinstance(dtype, T.TimestampNTZType):
        return epoch_seconds(c, dtype) * 1_000_000 + F.date_format(c, "SSSSSS").cast("long")
    return F.unix_micros(c.cast("timestamp"))


def mean(c: str | Column) -> Column:
    """Mean of the values that are there: NULL and NaN are missing, infinities count. Its last digits depend on the order
    of addition; comparisons across engines round it."""
    return F.avg(nan_to_null(c))


def round_floats(df, digits: int = 9):
    """Round every DOUBLE/FLOAT column, the comparison rule for results shared across engines."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
