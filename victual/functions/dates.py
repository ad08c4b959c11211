"""Calendar arithmetic on dates.  "Today" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(timestamp: Column) -> Column:
    """The calendar date in the session's time zone, which is UTC."""
    return F.to_date(timestamp)


def start_of_week(date: Column, starts_on: Column) -> Column:
    """``starts_on`` is 0 for Sunday to 6 for Saturday."""
    back = F.pmod(F.dayofweek(date) - 1 - starts_on, F.lit(7))
    return F.date_sub(date, back.cast("int"))


def end_of_week(date: Column, starts_on: Column) -> Column:
    return F.date_add(start_of_week(date, starts_on), 6)


def days_remaining(today: Column, starts_on: Column) -> Column:
    """Days left in the week with today, 1 to 7."""
    return F.greatest(F.lit(1), F.datediff(end_of_week(today, starts_on), today) + 1)


def in_range(date: Column, start: Column, end: Column) -> Column:
    """Closed at both ends; false for what isn't a date."""
    return F.coalesce(date.between(start, end), F.lit(False))


def age_on(birth: Column, today: Column) -> Column:
    """Full years by month and day: a birthday on 29 February is reached on 1 March of common years."""
    early = (F.month(today) < F.month(birth)) | ((F.month(today) == F.month(birth)) & (F.dayofmonth(today) < F.dayofmonth(birth)))
    return F.year(today) - F.year(birth) - early.cast("int")


def last_days(today: Column, days: int = 7) -> Column:
    """An array of the last ``days`` dates, today last."""
    return F.sequence(F.date_sub(today, days - 1), today)
