"""Date windows as pushable conditions, and times as numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def until_days_before(column: Column, date: str, days: int) -> Column:
    """``column <= date - days``."""
    return column <= F.date_sub(F.lit(date).cast("date"), days)


def within_months(column: Column, start: str, months: int) -> Column:
    """``start <= column < start + months``."""
    first = F.lit(start).cast("date")
    return (column >= first) & (column < F.add_months(first, months))


def within_month_seq(column: Column, first: int, count: int = 12) -> Column:
    """Dates whose month number, counted from January 1900, is in a range.

    Written as a date range so that the scan can skip by statistics.
    """
    return within_months(column, f"{1900 + first // 12}-{first % 12 + 1:02d}-01", count)


_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def epoch_micros(time: Column) -> Column:
    """Microseconds of a time without zone, for any session time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), time)


def instant(time: Column) -> Column:
    """The time without zone taken as UTC; event times must be instants."""
    return F.timestamp_micros(epoch_micros(time))


def wall_time(instant: Column) -> Column:
    """Back from an instant to the time without zone in UTC."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(_EPOCH))
