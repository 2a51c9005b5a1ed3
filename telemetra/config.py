"""Names, thresholds and rules shared by every stage.

Everything here is a fixed value that has to stay as it is for results to agree with the
original sensor pipeline: column names, default thresholds, label texts, contract ranges and
the tokens that count as a missing value in a text file.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: reading columns -------------------------------------------------------------
TIMESTAMP = "timestamp"
DEVICE = "device_id"
TEMPERATURE = "temperature_celsius"
HUMIDITY = "humidity_percent"
PRESSURE = "pressure_hpa"
BATTERY = "battery_level_percent"
READING_COLUMNS = [TIMESTAMP, DEVICE, TEMPERATURE, HUMIDITY, PRESSURE, BATTERY]
MEASURE_COLUMNS = [TEMPERATURE, HUMIDITY, PRESSURE, BATTERY]

# Tie-break for equal (device, timestamp) and the row id of a reading: the ingest order.
READING_ID = "reading_id"

# Columns repaired by interpolation; battery is not among them, so a missing battery drops the row.
INTERPOLATED_COLUMNS = [TEMPERATURE, HUMIDITY, PRESSURE]

# --- fixed values: derived columns -------------------------------------------------------------
FAHRENHEIT = "temperature_fahrenheit"
HOUR = "hour_of_day"
ROLLING = "temp_rolling_avg_3"
VALID_UNTIL = "valid_until"
ANOMALY_TYPE = "anomaly_type"
IS_ANOMALY = "is_anomaly"
DATE = "date"

# --- fixed values: anomaly rule ----------------------------------------------------------------
TEMP_THRESHOLD_HIGH = 30.0
BATTERY_THRESHOLD_LOW = 15.0
ROLLING_WINDOW = 3
LABEL_NORMAL = "Normal"
LABEL_HIGH_TEMP = "High Temperature"
LABEL_LOW_BATTERY = "Low Battery"
LABEL_BOTH = "High Temp & Low Battery"

# --- fixed values: data contract (inclusive ranges; pressure has none) ---------------------------
CONTRACT_RANGES = {
    TEMPERATURE: (-20.0, 50.0),
    HUMIDITY: (0.0, 100.0),
    BATTERY: (0.0, 100.0),
}

# --- fixed values: text tokens read as missing (the pandas CSV reader's defaults) ----------------
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


@dataclass(frozen=True)
class Thresholds:
    """Anomaly thresholds; an explicit value (0.0 included) always beats the default."""

    temp_high: float = TEMP_THRESHOLD_HIGH
    battery_low: float = BATTERY_THRESHOLD_LOW

    @classmethod
    def of(cls, temp_high: float | None = None, battery_low: float | None = None) -> "Thresholds":
        return cls(
            TEMP_THRESHOLD_HIGH if temp_high is None else float(temp_high),
            BATTERY_THRESHOLD_LOW if battery_low is None else float(battery_low),
        )


# Ordered per-device scans cut each device's history into time segments, the unit of work of the
# windows. ``None`` sizes segments per device from its row count and time span so that a segment
# holds about TARGET_SEGMENT_ROWS rows (a device owning a third of the data gets many segments);
# an int fixes the width in seconds for every device.
DEFAULT_SEGMENT_SECONDS = None
TARGET_SEGMENT_ROWS = 1_000_000
