"""Readers: CSV text, Parquet stores, and readings derived from the shared ``events`` table."""
from .events import load_readings, load_text_readings, readings_as_text, readings_from_events
from .readers import coercion_report, parse_readings, read_readings_csv, read_readings_parquet

__all__ = ["load_readings", "load_text_readings", "readings_as_text", "readings_from_events",
           "coercion_report", "parse_readings", "read_readings_csv", "read_readings_parquet"]
