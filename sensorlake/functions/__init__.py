"""Column functions: units, calendar, slots."""

from .calendar import is_leap_year, iso_text, next_file_boundary, posix_parts, posix_seconds, valid_calendar
from .units import DEFAULTS, gnss_posix_seconds, outlier_masks, scale_gnss, scale_imu, utc_micros

__all__ = ["DEFAULTS", "gnss_posix_seconds", "is_leap_year", "iso_text", "next_file_boundary", "outlier_masks", "posix_parts", "posix_seconds", "scale_gnss", "scale_imu", "utc_micros", "valid_calendar"]
