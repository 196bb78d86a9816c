"""Shapes that recur: counted categories, top-k before decoration, patient naming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carestrata.functions.scalars import full_name


def person_name() -> Column:
    return full_name("first_name", "last_name")


def counted(df: DataFrame, column: str, count: str = "count") -> DataFrame:
    """Rows per value, most frequent first; a NULL group is kept."""
    return (df.groupBy(column).agg(F.count("*").alias(count))
            .orderBy(F.desc(count), F.asc_nulls_last(column)))


def top_with(df: DataFrame, order: Sequence[Column], k: int,
             *parents: tuple[DataFrame, str]) -> DataFrame:
    """First ``k`` rows in order, each with the columns of its parents.

    Rows without one of the parents do not count towards ``k``: only keys are compared for that. The rows are
    chosen before they are widened; a parent's key is unique, so there are never more than ``k`` of them.
    """
    for parent, key in parents:
        df = df.join(parent.select(key), key, "left_semi")
    rows = df.orderBy(*order).limit(k)
    for parent, key in parents:
        rows = parent.join(rows, key)
    return rows.orderBy(*order)


def named_patients(patients: DataFrame, *extra: str) -> DataFrame:
    return patients.select("patient_id", *extra, person_name().alias("patient_name"))


def for_patient(df: DataFrame, patient_id: object | None, order: Sequence[Column]) -> DataFrame:
    """One patient's rows in display order, or every patient's rows without a global sort."""
    if patient_id is None:
        return df
    return df.filter(F.col("patient_id") == F.lit(patient_id)).orderBy(*order)


def one_value(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of a column: the choices of a facet."""
    return df.select(column).distinct().orderBy(F.asc_nulls_last(column))


def ids(df: DataFrame, key: str = "patient_id") -> DataFrame:
    """Distinct keys, for semi-joins: duplicates go before the shuffle, not after."""
    return df.select(key).distinct()
