"""Dates and times. No clock function is used anywhere: a cut-off date is a parameter."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Format tokens of the source warehouse and their Spark patterns.
FORMAT_TOKENS = {
    "YYYY": "yyyy",
    "YY": "yy",
    "MMMM": "MMMM",
    "MON": "MMM",
    "MM": "MM",
    "DD": "dd",
    "DY": "E",
    "HH24": "HH",
    "HH12": "hh",
    "AM": "a",
    "PM": "a",
    "MI": "mm",
    "SS": "ss",
    "FF3": "SSS",
    "FF6": "SSSSSS",
}
_TOKEN = re.compile("|".join(sorted(FORMAT_TOKENS, key=len, reverse=True)))
_MONTHS = {"month": 1, "quarter": 3, "year": 12}
_DAYS = {"day": 1, "week": 7}
_SECONDS = {"hour": 3600, "minute": 60, "second": 1}


def to_char(value: Column, fmt: str) -> Column:
    return F.date_format(value, _TOKEN.sub(lambda m: FORMAT_TOKENS[m.group()], fmt))


def timestamp_text(value: Column) -> Column:
    """Default text of a timestamp: always three fraction digits."""
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSS")


def add_to_date(part: str, n, value: Column) -> Column:
    """A DATE stays a DATE and month ends clamp; hours, minutes and seconds make it a timestamp."""
    n = n if isinstance(n, Column) else F.lit(n)
    if part in _MONTHS:
        return F.add_months(value, n * _MONTHS[part])
    if part in _SECONDS:
        return add_to_timestamp(part, n, value.cast("timestamp_ntz"))
    return F.date_add(value, n * _DAYS[part])


def add_to_timestamp(part: str, n, value: Column) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    zero = F.lit(0)
    if part in _MONTHS:
        return value + F.make_ym_interval(zero, n * _MONTHS[part])
    seconds = {**_SECONDS, **{k: v * 86400 for k, v in _DAYS.items()}}[part]
    return value + F.make_dt_interval(zero, zero, zero, (n * seconds).cast("decimal(18,6)"))


def boundaries_between(part: str, start: Column, end: Column) -> Column:
    """Number of ``part`` boundaries crossed from ``start`` to ``end`` (23:59 -> 00:01 is one day)."""
    if part == "day":
        return F.datediff(end.cast("date"), start.cast("date")).cast("bigint")
    if part == "week":
        return _monday(end) - _monday(start)
    if part in _MONTHS:
        months = lambda d: F.year(d) * 12 + F.month(d) - 1
        size = _MONTHS[part]
        return (F.floor(months(end) / size) - F.floor(months(start) / size)).cast("bigint")
    units = lambda t: F.floor(_epoch_seconds(t) / _SECONDS[part])
    return (units(end) - units(start)).cast("bigint")


def _monday(value: Column) -> Column:
    # Weeks since Monday 1970-01-05.
    return F.floor(F.datediff(value.cast("date"), F.lit("1970-01-05").cast("date")) / 7).cast("bigint")


def _epoch_seconds(value: Column) -> Column:
    """Wall-clock seconds of a zone-less timestamp, independent of the session zone."""
    wall = value.cast("timestamp_ntz")
    days = F.datediff(wall.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(wall) * 3600 + F.minute(wall) * 60 + F.second(wall)


def wall_micros(value: Column) -> Column:
    """Wall-clock microseconds of a zone-less timestamp, independent of the session zone."""
    wall = value.cast("timestamp_ntz")
    fraction = (F.extract(F.lit("SECOND"), wall) * 1_000_000).cast("bigint") - F.second(wall) * 1_000_000
    return _epoch_seconds(wall) * 1_000_000 + fraction


def epoch_seconds(value: Column) -> Column:
    """Whole seconds since 1970, fraction dropped."""
    return _epoch_seconds(value)


def trunc_date(part: str, value: Column) -> Column:
    """DATE in, DATE out; weeks start on Monday, and parts of a day leave the date as it is."""
    if part not in {**_MONTHS, **_DAYS, **_SECONDS}:
        raise ValueError(f"unknown part {part!r}")
    day = value.cast("date")
    return day if part == "day" or part in _SECONDS else F.trunc(day, part)


def trunc_timestamp(part: str, value: Column) -> Column:
    return F.date_trunc(part, value).cast("timestamp_ntz")


def day_name(value: Column) -> Column:
    return F.dayname(value)


def month_name(value: Column) -> Column:
    return F.monthname(value)


def day_of_week(value: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(value) - 1


def day_of_week_iso(value: Column) -> Column:
    return F.weekday(value) + 1


def week_of_year(value: Column) -> Column:
    """ISO week. The source warehouse makes this a session policy, so a port reviews each use."""
    return F.weekofyear(value)


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """Months and days outside the calendar carry over, as in the source warehouse."""
    first = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1)
    return F.date_add(first, day - 1)


def timestamp_from_parts(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Every part may lie outside its range and carries over into the larger ones."""
    days = date_from_parts(year, month, day).cast("timestamp_ntz")
    return days + F.make_dt_interval(F.lit(0), hour, minute, second.cast("decimal(18,6)"))


def to_timestamp(text: Column, fmt: str | None = None) -> Column:
    if fmt is None:
        return text.cast("timestamp_ntz")
    return F.to_timestamp_ntz(text, F.lit(_TOKEN.sub(lambda m: FORMAT_TOKENS[m.group()], fmt)))


def to_date(text: Column, fmt: str | None = None) -> Column:
    if fmt is None:
        return text.cast("date")
    return F.to_date(text, _TOKEN.sub(lambda m: FORMAT_TOKENS[m.group()], fmt))


def convert_timezone(source: str, target: str, value: Column) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), value.cast("timestamp_ntz"))
