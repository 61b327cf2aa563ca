"""Calendar expressions on date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of days and months.
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def week_label(day: Column) -> Column:
    """``YYYY-Wnn`` with Monday weeks counted 00-53 inside the calendar year.

    The days before the first Monday are week 00, so a week that spans New Year
    falls into two labels.
    """
    week = F.floor((F.dayofyear(day) + F.lit(6) - F.weekday(day)) / F.lit(7))
    return F.concat(F.year(day).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def week_start(day: Column) -> Column:
    return F.trunc(day, "week")


def week_end(day: Column) -> Column:
    """The Sunday that closes the week."""
    return F.date_add(week_start(day), 6)


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def month_name(day: Column) -> Column:
    return F.date_format(day, "MMM")


def weekday_name(day: Column) -> Column:
    return F.date_format(day, "E")


def weekday_number(day: Column) -> Column:
    """0 = Sunday .. 6 = Saturday."""
    return F.dayofweek(day) - F.lit(1)


def months_between_months(later: Column, earlier: Column) -> Column:
    """Whole calendar months from one date's month to another's."""
    return (F.year(later) * 12 + F.month(later)) - (F.year(earlier) * 12 + F.month(earlier))


def add_hours(day: Column, hours: Column) -> Column:
    """Date reached when ``hours`` pass from the start of ``day``."""
    return F.date_add(day, F.floor(hours / F.lit(24)).cast("int"))
