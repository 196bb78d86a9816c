"""Scalar expressions with the exact rounding, date and NULL rules the reports need."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,18)"


def as_date(value: date | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def completed_years(born: Column, as_of: date | str | Column) -> Column:
    """Birthdays reached by ``as_of``; someone born on 29 February ages on 1 March off leap years."""
    day = as_date(as_of)
    before_birthday = (F.month(day) * 100 + F.day(day)) < (F.month(born) * 100 + F.day(born))
    return F.year(day) - F.year(born) - before_birthday.cast("int")


def full_name(first: str | Column, last: str | Column) -> Column:
    """NULL when either part is NULL."""
    return F.concat(first, F.lit(" "), last)


def days_between(end: str | Column, start: str | Column) -> Column:
    return F.date_diff(end, start)


def rounded_quotient(numerator: Column, denominator: Column, digits: int) -> Column:
    """``numerator / denominator`` half-up to ``digits``, NULL for a zero denominator.

    The division runs in 18 decimal places, so rounding happens once.
    """
    quotient = numerator.cast(WIDE) / F.nullif(denominator, F.lit(0))
    return F.round(quotient, digits).cast("double")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return rounded_quotient(part * 100, whole, digits)


def mean_of(total: Column, count: Column, digits: int = 2) -> Column:
    return rounded_quotient(total, count, digits)


def percent_change(baseline: Column, result: Column) -> Column:
    """Change against the baseline in %, one decimal; NULL without a usable baseline."""
    change = (result - baseline) * 100 / F.nullif(baseline, F.lit(0).cast("decimal(10,2)"))
    return F.round(change, 1).cast("double")


def exact_slope(y: Column, x: Column, places: int) -> Column:
    """Least-squares slope (an aggregate) of decimals with ``places`` places on whole numbers.

    The sums are whole numbers too, so the result does not depend on the order rows arrive in.
    NULL when x does not vary.
    """
    both = y.isNotNull() & x.isNotNull()
    units = F.when(both, (y * 10**places).cast("decimal(28,0)"))
    at = F.when(both, x.cast("decimal(28,0)"))
    n, sx, sy = F.count(units).cast("decimal(20,0)"), F.sum(at), F.sum(units)
    sxy, sxx = (F.sum((at * v).cast("decimal(28,0)")) for v in (units, at))
    spread = (n * sxx - sx * sx).cast("double")
    return (n * sxy - sx * sy).cast("double") / F.nullif(spread * 10**places, F.lit(0.0))


def utc_text(ts: Column) -> Column:
    """Timestamp as text with its zone offset, e.g. ``2025-01-15 15:00:00+00``."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd HH:mm:ssx")


def clipped(text: str | Column, length: int) -> Column:
    return F.substring(text, 1, length)


def blank_to_null(text: str | Column) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.when(F.trim(col) != "", col)


def month_index(day: Column) -> Column:
    """Months since year 0, for month-by-month series."""
    return F.year(day) * 12 + F.month(day) - 1


def stable_uuid(*parts: Column) -> Column:
    """An id that comes out the same when a lost task is run again, unlike a random one."""
    h = F.md5(F.concat_ws("|", *parts))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, start, n) for start, n in cuts])
