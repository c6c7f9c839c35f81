"""Time parsing and differences. Times are `timestamp_ntz`; differences are doubles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

# Missing spellings of a time and the accepted formats.
MISSING_TIME = ("", "nan", "nat", "none")
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/M/d H:mm", "yyyy/M/d", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd")
OUTPUT_FORMAT = "yyyy-MM-dd HH:mm:ss"
# A gap to a missing time in hours, and the start of offset time.
FAR_HOURS = 1e9
OFFSET_ORIGIN = dt.datetime(2000, 1, 1)
# Limits of a horizon taken from two times, in days (one minute, one year).
SHORTEST_DAYS, LONGEST_DAYS = 1.0 / 1440.0, 365.0


def parse_time(value: Column) -> Column:
    """Time from text in any accepted format; a date reads as its midnight."""
    text = F.trim(value.cast("string"))
    known = F.when(~F.lower(text).isin(*MISSING_TIME), text)
    return F.coalesce(*[F.try_to_timestamp(known, F.lit(f)) for f in TIME_FORMATS]).cast("timestamp_ntz")


def time_text(value: Column) -> Column:
    return F.date_format(value, OUTPUT_FORMAT)


def micros(value: Column) -> Column:
    return F.unix_micros(value.cast("timestamp"))


def hours_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(3_600_000_000.0)


def days_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(86_400_000_000.0)


def gap_hours(start: Column, end: Column) -> Column:
    """Hours from start to end; a missing time is infinitely far, so `gap < k` is never null."""
    return F.coalesce(hours_between(start, end), F.lit(FAR_HOURS))


def horizon_between(start: Column, end: Column) -> Column:
    """Days between, held to the limits of a horizon; null when a time is missing."""
    days = days_between(start, end)
    return F.when(days.isNotNull(), F.least(F.greatest(days, F.lit(SHORTEST_DAYS)), F.lit(LONGEST_DAYS)))


def add_days(value: Column, days: Column) -> Column:
    moved = F.timestamp_micros(micros(value) + F.round(days * F.lit(86_400_000_000.0)).cast("bigint"))
    return moved.cast("timestamp_ntz")


def add_hours(value: Column, hours: Column) -> Column:
    return add_days(value, hours / F.lit(24.0))


def offset_time(minutes: Column) -> Column:
    """Minute offset as a time on the offset time line."""
    origin = F.lit(OFFSET_ORIGIN).cast("timestamp_ntz")
    return add_days(origin, minutes.cast("double") / F.lit(1440.0))
