"""Conditions on a table's own columns that also bound the partitions of a stored table.

A stored table carries, besides a date, the month it falls into (``<date>_month``, e.g. 202401), and besides a
coded column a slice of it (``<column>_slice``), both as folders. The helpers here add the bounds on these columns
where the table has them; a table without them is filtered all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carestrata.functions.predicates import abnormal, every
from carestrata.functions.scalars import as_date


def month_number(day: Column) -> Column:
    return F.year(day) * 100 + F.month(day)


def month_column(date_column: str) -> str:
    return f"{date_column}_month"


def slice_column(column: str) -> str:
    return f"{column}_slice"


def in_days(df: DataFrame, date_column: str, since=None, before=None) -> DataFrame:
    """Rows whose date (or timestamp) lies from the day ``since`` on and earlier than the day ``before``.

    Either may be None. They are dates or expressions of literals, so the month bounds fold to constants and
    choose folders before a file is listed.
    """
    day, month = F.col(date_column), month_column(date_column)
    stored = month in df.columns
    bounds = []
    if since is not None:
        bounds += [day >= as_date(since), F.col(month) >= month_number(as_date(since)) if stored else None]
    if before is not None:
        last = F.date_sub(as_date(before), 1)
        bounds += [day < as_date(before), F.col(month) <= month_number(last) if stored else None]
    return df.filter(every(*bounds))


def only_abnormal(labs: DataFrame) -> DataFrame:
    """Results with a flag other than normal, from their own slice of a stored table."""
    part = slice_column("abnormal_flag")
    return labs.filter(every(abnormal(), F.col(part) if part in labs.columns else None))
