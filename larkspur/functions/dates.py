"""Starts of calendar periods and steps between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("day", "week", "month")


def start_of(period: str, d: Column, week_start: str = "monday") -> Column:
    """The first day of the day, week or month of ``d``; weeks start on monday or sunday."""
    if period == "day":
        return F.to_date(d)
    if period == "month":
        return F.trunc(d, "MM")
    if period != "week":
        raise ValueError(f"unknown period {period!r}; one of {PERIODS}")
    if week_start == "sunday":
        return F.date_sub(d, F.dayofweek(d) - 1)
    return F.to_date(F.date_trunc("week", d))


def periods_between(period: str, start: Column, d: Column) -> Column:
    """Whole periods from ``start`` (a period's first day) to ``d``, rounded down."""
    if period == "month":
        return (F.year(d) - F.year(start)) * 12 + F.month(d) - F.month(start)
    days = F.date_diff(d, start)
    return days if period == "day" else F.floor(days / 7).cast("int")
