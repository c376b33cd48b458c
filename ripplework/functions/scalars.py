"""Scalar expressions that queries over live views use. All pass null on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(c: Column, width: float) -> Column:
    """The lower end of c's bucket."""
    return (F.floor(c / width) * width).cast("long")


def clamp(c: Column, low: float | None = None, high: float | None = None) -> Column:
    out = c
    if high is not None:
        out = F.least(F.lit(high), out)
    if low is not None:
        out = F.greatest(F.lit(low), out)
    return F.when(c.isNotNull(), out)


def day(c: Column) -> Column:
    return F.date_trunc("day", c).cast("timestamp_ntz")


def number(c: Column) -> Column:
    """Text as a number, null where it is none."""
    return c.try_cast("double")


def hour_of(c: Column) -> Column:
    """Hours since midnight, minutes as fractions."""
    return F.hour(c) + F.minute(c) / 60


def month_day_time(c: Column, year: int) -> Column:
    """A time from MMddHHmm text."""
    return F.try_to_timestamp(F.concat(F.lit(str(year)), c), F.lit("yyyyMMddHHmm")).cast("timestamp_ntz")


def day_label(c: Column) -> Column:
    """month-day-year, months from 0."""
    return F.concat_ws("-", F.month(c) - 1, F.dayofmonth(c), F.year(c))


def spread(ask: Column, bid: Column) -> Column:
    return F.round(ask - bid, 2)
