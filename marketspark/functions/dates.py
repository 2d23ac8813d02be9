"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Mean length of a month and of a year in days.
DAYS_PER_MONTH = 30.4375
DAYS_PER_YEAR = 365.25


def _is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def _leap_day(d: Column) -> Column:
    return (F.month(d) == 2) & (F.dayofmonth(d) == 29)


def normalize_year(d: Column, year: Column) -> Column:
    """Same month and day in another year; null where that day does not exist."""
    return F.when(
        ~_leap_day(d) | _is_leap(year), F.make_date(year, F.month(d), F.dayofmonth(d))
    )


def normalize_doy(d: Column, shift: int = -1) -> Column:
    """Overlay on the leap year 2020 by day of the year; ``shift=0`` is the off-by-one variant."""
    return F.date_add(F.to_date(F.lit("2020-01-01")), F.dayofyear(d) + F.lit(shift))


def plus_years(d: Column, years: int) -> Column:
    """Calendar years later (earlier if negative); null where the day does not exist."""
    target = F.year(d) + F.lit(years)
    return F.when(~_leap_day(d) | _is_leap(target), F.add_months(d, 12 * years))


def months_of(days: Column) -> Column:
    return days / F.lit(DAYS_PER_MONTH)


def years_of(days: Column) -> Column:
    return days / F.lit(DAYS_PER_YEAR)


def next_year_start(d: Column) -> Column:
    """First of January after ``d``, also when ``d`` is itself a first of January."""
    return F.add_months(F.trunc(d, "YEAR"), 12)


def caption_date(d: Column) -> Column:
    return F.date_format(d, "MMM dd, yyyy")
