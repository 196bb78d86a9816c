"""Typed filters: optional facets and the three-column patient search."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def every(*conditions: Column | None) -> Column:
    """AND of the given conditions; ``None`` and the empty list filter nothing."""
    chosen = [c for c in conditions if c is not None]
    return reduce(and_, chosen) if chosen else F.lit(True)


def equals(column: str, value: object | None) -> Column | None:
    return None if value is None else F.col(column) == F.lit(value)


def treatment_facets(treatment_type: str | None = None, status: str | None = None) -> Column:
    return every(equals("treatment_type", treatment_type), equals("status", status))


def ae_facets(severity: str | None = None, event_type: str | None = None,
              unresolved_only: bool = False) -> Column:
    return every(equals("severity", severity), equals("event_type", event_type),
                 F.col("resolution_date").isNull() if unresolved_only else None)


def lab_facets(test_name: str | None = None, abnormal_flag: str | None = None) -> Column:
    return every(equals("test_name", test_name), equals("abnormal_flag", abnormal_flag))


def patient_search(term: str) -> Column:
    """Case-insensitive match in name or MRN; ``%`` and ``_`` in the term stay wildcards."""
    pattern = f"%{term}%"
    return reduce(or_, [F.col(c).ilike(pattern) for c in ("first_name", "last_name", "mrn")])


def abnormal() -> Column:
    """A missing flag is neither normal nor abnormal and is left out."""
    return F.col("abnormal_flag") != "N"
