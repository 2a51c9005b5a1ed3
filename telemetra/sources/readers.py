"""Reading sensor data: CSV text (header row), Parquet, and the text → typed step shared by both.

Text is read as STRING and parsed column by column, so that a *missing* value (a missing-value
token) and a *malformed* one (text that does not parse) stay apart: the first becomes NULL, the second
either fails the job or becomes NULL and shows up in ``coercion_report``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config as C
from ..functions.columns import missing_to_null, nan_to_null

# Target type of each reading column after coercion.
READING_TYPES = {
    C.TIMESTAMP: "timestamp_ntz",
    C.DEVICE: "string",
    C.TEMPERATURE: "double",
    C.HUMIDITY: "double",
    C.PRESSURE: "double",
    C.BATTERY: "double",
}

# Needed before cleaning can start; pressure may be absent until validation.
REQUIRED_FOR_CLEANING = [C.TIMESTAMP, C.DEVICE, C.TEMPERATURE, C.HUMIDITY]


class MalformedValueError(ValueError):
    pass


def _read(spark: SparkSession, fn, path):
    try:
        return fn(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"File not found at: {path}") from e
        raise ValueError(f"Failed to read {path}: {e}") from e


_SURPLUS = "_ragged_row"


def _by_header(spark: SparkSession, path: str, multi_line: bool) -> dict[tuple[str, ...], list[str]]:
    """The files of ``path`` by their header rows; one short job a file."""
    found: dict[tuple[str, ...], list[str]] = {}
    for f in sorted(_read(spark, lambda p: spark.read.text(p), path).inputFiles()):
        names = spark.read.option("header", True).option("inferSchema", False).option("multiLine", multi_line).csv(f).columns
        found.setdefault(tuple(names), []).append(f)
    return found


def read_readings_csv(spark: SparkSession, path: str, malformed: str = "raise",
                      with_reading_id: bool = True, multi_line: bool = False, mixed_headers: bool = False) -> DataFrame:
    """Load readings from CSV file(s) with a header row.

    ``malformed``: ``"raise"`` fails the job on the first value that is neither missing nor parsable
    (checked while the data streams through, no extra pass); ``"null"`` turns it into NULL. A row with more or fewer fields than
    the header always fails, and so does a file whose header is not that of the first one. ``mixed_headers`` reads each file by its own header:
    columns may stand in another order, and those that a file lacks are missing there. ``multi_line`` reads quoted line breaks, a file then being one task.
    ``reading_id`` numbers rows in ingest order (within a file, increasing with the position).
    """
    if mixed_headers:
        parts = [_text_rows(spark, files, multi_line) for files in _by_header(spark, path, multi_line).values()]
        raw = parts[0]
        for p in parts[1:]:
            raw = raw.unionByName(p, allowMissingColumns=True)
    else:
        raw = _text_rows(spark, path, multi_line)
    if with_reading_id:
        raw = raw.withColumn(C.READING_ID, F.monotonically_increasing_id())
    return parse_readings(raw, malformed=malformed)


def _text_rows(spark: SparkSession, path: str | list[str], multi_line: bool) -> DataFrame:
    """The rows of files with one header, all columns as text."""
    reader = lambda: spark.read.option("header", True).option("inferSchema", False).option("multiLine", multi_line)
    names = _read(spark, lambda p: reader().csv(p), path).columns
    schema = ", ".join(f"`{c}` string" for c in [*names, _SURPLUS])
    raw = _read(spark, lambda p: reader().schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _SURPLUS)
                .option("enforceSchema", False).csv(p), path)
    fields = F.when(F.col(_SURPLUS).isNotNull(), F.raise_error(F.concat(F.lit("row with another number of fields than the header: "), F.col(_SURPLUS))))
    return raw.select(*[F.coalesce(fields.cast("string"), F.col(f"`{c}`")).alias(c) if c == names[0] else F.col(f"`{c}`") for c in names])


def read_readings_parquet(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Load stored readings, NaN as missing; on a ``date``-partitioned store a date range prunes directories."""
    df = _read(spark, spark.read.parquet, path)
    df = df.select(*[nan_to_null(c).alias(c) if c in C.MEASURE_COLUMNS and df.schema[c].dataType.simpleString() in ("double", "float")
                     else F.col(c) for c in df.columns])
    if start is not None or end is not None:
        from ..operators.filters import date_range_filter
        df = date_range_filter(df, start, end)
    return df


def _parsed(text_col: str, target: str):
    return missing_to_null(F.col(text_col)).try_cast(target)


def parse_readings(raw: DataFrame, malformed: str = "raise") -> DataFrame:
    """Text columns → typed reading columns (unknown extra columns are kept as they are)."""
    missing = [c for c in REQUIRED_FOR_CLEANING if c not in raw.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    out = []
    for c in raw.columns:
        target = READING_TYPES.get(c)
        if target is None:
            out.append(F.col(c))
            continue
        if raw.schema[c].dataType.simpleString() != "string":
            value = F.col(c).try_cast(target)
            if malformed == "raise":
                value = F.when(F.col(c).isNotNull() & value.isNull(), F.raise_error(F.concat(
                    F.lit(f"malformed value in column {c}: "), F.col(c).cast("string")))).otherwise(value)
            if target == "double":
                value = nan_to_null(value)
            out.append(value.alias(c))
            continue
        text = missing_to_null(F.col(c))
        value = _parsed(c, target)
        if target == "double":
            value = nan_to_null(value)
        if malformed == "raise":
            bad = text.isNotNull() & value.isNull() & ~F.lower(text).isin("nan", "-nan")
            value = F.when(bad, F.raise_error(F.concat(
                F.lit(f"malformed value in column {c}: "), text))).otherwise(value)
        elif malformed != "null":
            raise ValueError("malformed must be 'raise' or 'null'")
        out.append(value.alias(c))
    return raw.select(*out)


def coercion_report(raw: DataFrame) -> DataFrame:
    """Per reading column of a text frame: values present, missing (token or empty), malformed."""
    cols = [c for c in raw.columns if c in READING_TYPES]
    aggs = []
    for c in cols:
        text = missing_to_null(F.col(c))
        value = nan_to_null(_parsed(c, READING_TYPES[c])) if READING_TYPES[c] == "double" \
            else _parsed(c, READING_TYPES[c])
        nan_text = F.lower(text).isin("nan", "-nan")
        aggs += [F.count_if(value.isNotNull()).alias(f"{c}__ok"),
                 F.count_if(text.isNull() | nan_text).alias(f"{c}__missing"),
                 F.count_if(text.isNotNull() & value.isNull() & ~nan_text).alias(f"{c}__malformed")]
    wide = raw.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__ok`, `{c}__missing`, `{c}__malformed`" for c in cols)
    return wide.selectExpr(
        f"stack({len(cols)}, {stack}) as (column_name, n_ok, n_missing, n_malformed)")
