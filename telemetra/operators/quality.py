"""Data quality: missing-value profile, dropping incomplete rows, and the reading contract.

The contract is a list of rules evaluated as one array expression per row; failing rules are
exploded into a report. All failures come out of one scan with no shuffle and no Python; ``enforce``
counts them (one action) and raises with a summary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions.columns import nan_to_null


def missing_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Number of missing values per column, in one pass: (column_name, missing_count)."""
    cols = cols or [c for c in df.columns if not c.startswith("_")]
    missing = {c: F.col(c).isNull() | F.isnan(c) if df.schema[c].dataType.simpleString() in ("double", "float") else F.col(c).isNull() for c in cols}
    wide = df.agg(*[F.count_if(missing[c]).alias(c) for c in cols])
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) as (column_name, missing_count)")


class ContractViolation(Exception):
    """Raised by ``enforce`` when readings break the contract; carries a per-rule summary."""

    def __init__(self, message: str, summary: list[tuple], examples: list[tuple]):
        super().__init__(message)
        self.summary = summary
        self.examples = examples


@dataclass(frozen=True)
class Rule:
    column: str
    check: str
    failed: Column          # TRUE when the row breaks the rule
    value: Column | None    # the offending numeric value, for the report


def contract_rules() -> list[Rule]:
    """The reading contract: every column present and non-null; inclusive ranges where declared.
    A range rule passes on NULL (the not-null rule reports that case)."""
    rules = []
    for c in C.READING_COLUMNS:
        gone = nan_to_null(c).isNull() if c in C.MEASURE_COLUMNS else F.col(c).isNull()
        rules.append(Rule(c, "not_nullable", gone, None))
    for c, (lo, hi) in C.CONTRACT_RANGES.items():
        x = nan_to_null(c)
        rules.append(Rule(c, f"greater_than_or_equal_to({lo:g})", x < lo, x))
        rules.append(Rule(c, f"less_than_or_equal_to({hi:g})", x > hi, x))
    return rules


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in C.READING_COLUMNS if c not in df.columns]


def validation_report(df: DataFrame, row_id: str = C.READING_ID) -> DataFrame:
    """One row per (reading, broken rule): row id, device, time, column, check, failure value."""
    absent = missing_columns(df)
    if absent:
        raise ValueError(f"column(s) not in the frame: {', '.join(absent)}")
    rules = contract_rules()
    entries = F.array(*[F.struct(F.lit(r.column).alias("column_name"), F.lit(r.check).alias("check"),
                                 F.coalesce(r.failed, F.lit(False)).alias("failed"),
                                 (r.value if r.value is not None else F.lit(None)).cast("double")
                                 .alias("failure_value")) for r in rules])
    ids = [F.col(row_id)] if row_id in df.columns else []
    failed = F.filter(entries, lambda e: e["failed"])
    return (df.select(*ids, F.col(C.DEVICE), F.col(C.TIMESTAMP), F.explode(failed).alias("_f"))
              .select(*ids, C.DEVICE, C.TIMESTAMP, "_f.column_name", "_f.check", "_f.failure_value"))


def validation_summary(df: DataFrame) -> DataFrame:
    """Failure count per (column, check)."""
    return (validation_report(df).groupBy("column_name", "check")
            .agg(F.count(F.lit(1)).alias("failure_count")))


def enforce(df: DataFrame, examples: int = 10) -> DataFrame:
    """Raise ``ContractViolation`` if any reading breaks the contract, else return the frame.

    Costs one action over the frame; callers that go on using it should persist it first.
    """
    absent = missing_columns(df)
    if absent:
        raise ContractViolation(f"Schema validation failed: column(s) not in the frame: {', '.join(absent)}",
                                [(c, "column_in_dataframe", 1) for c in absent], [])
    summary = [tuple(r) for r in validation_summary(df).orderBy("column_name", "check").collect()]
    if summary:
        total = sum(r[2] for r in summary)
        shown = [tuple(r) for r in validation_report(df).limit(examples).collect()]
        lines = "; ".join(f"{c} {chk}: {n}" for c, chk, n in summary)
        raise ContractViolation(f"Schema validation failed: {total} failure(s): {lines}", summary, shown)
    return df


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (readings that keep the contract, readings that break it)."""
    bad = F.lit(False)
    for r in contract_rules():
        bad = bad | F.coalesce(r.failed, F.lit(False))
    return df.filter(~bad), df.filter(bad)


def validate(df: DataFrame, mode: str = "enforce") -> DataFrame:
    """``enforce`` raises on any failure; ``report``/``off`` return the frame unchanged (use
    ``validation_report`` for the details); ``quarantine`` keeps only passing rows."""
    if mode == "enforce":
        return enforce(df)
    if mode == "quarantine":
        return quarantine(df)[0]
    if mode in ("report", "off"):
        return df
    raise ValueError(f"unknown validation mode {mode!r}")
