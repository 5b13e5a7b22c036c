"""Posix seconds and calendar, in UTC whatever the session's time zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT_SECONDS = 900


def _moment(seconds: Column) -> Column:
    """A timestamp without time zone."""
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def posix_parts(seconds: Column) -> Column:
    """Struct of year, month, day, hour, minute, second."""
    at = _moment(seconds)
    return F.struct(*[f(at).alias(n) for n, f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour), ("minute", F.minute), ("second", F.second))])


def iso_text(seconds: Column) -> Column:
    """2026-02-08T14:15:00"""
    return F.date_format(_moment(seconds), "yyyy-MM-dd'T'HH:mm:ss")


def valid_calendar(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    days = F.when(month == 2, F.when(is_leap_year(year), 29).otherwise(28)).otherwise(F.when(month.isin(4, 6, 9, 11), 30).otherwise(31))
    return year.between(1970, 2105) & month.between(1, 12) & (day >= 1) & (day <= days) & hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)


def posix_seconds(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Seconds since 1970; null for what isn't a calendar time."""
    whole = F.datediff(F.make_date(year, month, day), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + hour * 3600 + minute * 60 + second
    return F.when(valid_calendar(year, month, day, hour, minute, second), whole)


def is_leap_year(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def next_file_boundary(seconds: Column, slot: int = SLOT_SECONDS) -> Column:
    """The first multiple of the slot after ``seconds``."""
    return seconds - F.pmod(seconds, F.lit(slot)) + slot
