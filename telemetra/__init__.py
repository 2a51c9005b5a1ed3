"""telemetra: sensor-telemetry cleaning, anomaly and rollup jobs on Spark DataFrames."""
from . import config
from .operators.anomaly import anomalies, anomaly_counts, classify
from .operators.cleaning import clean, dropped_count
from .operators.derive import transform
from .operators.quality import (ContractViolation, enforce, missing_profile, validation_report,
                                validation_summary)
from .operators.rollups import daily_stats
from .operators.timeseries import interpolate_linear, rolling_mean_3, valid_until

__all__ = ["config", "anomalies", "anomaly_counts", "classify", "clean", "dropped_count", "transform",
           "ContractViolation", "enforce", "missing_profile", "validation_report", "validation_summary",
           "daily_stats", "interpolate_linear", "rolling_mean_3", "valid_until"]
