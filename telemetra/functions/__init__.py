from .columns import (epoch_micros, epoch_seconds, fahrenheit, hour_of_day, is_true, mean,
                      missing_to_null, nan_to_null, round_floats)

__all__ = ["epoch_micros", "epoch_seconds", "fahrenheit", "hour_of_day", "is_true", "mean",
           "missing_to_null", "nan_to_null", "round_floats"]
