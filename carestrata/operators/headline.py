"""Headline counts. The metric names are fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stack(counts: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    rows = [df.agg(how.alias("value")).select(F.lit(i).alias("position"), F.lit(metric).alias("metric"),
                                              "value")
            for i, (metric, df, how) in enumerate(counts)]
    return reduce(DataFrame.unionByName, rows).orderBy("position")


def headline_counts(patients: DataFrame, providers: DataFrame, encounters: DataFrame,
                    treatments: DataFrame, adverse_events: DataFrame) -> DataFrame:
    """metric, value: the five numbers at the top of the overview."""
    active, n = F.count_if("is_active"), F.count("*")
    return _stack([
        ("Active Patients", patients, active), ("Active Providers", providers, active),
        ("Total Encounters", encounters, n), ("Treatments", treatments, n),
        ("Adverse Events", adverse_events, n),
    ]).drop("position")


def kpi_cards(patients: DataFrame, treatments: DataFrame, encounters: DataFrame,
              adverse_events: DataFrame) -> DataFrame:
    """metric, value (text). Each table is scanned once; adverse events give two cards."""
    events = adverse_events.agg(F.count("*").alias("a"), F.count_if(F.col("ctcae_grade") >= 3).alias("b"))
    pairs = F.explode(F.array(
        F.struct(F.lit(3).alias("position"), F.lit("Adverse Events").alias("metric"),
                 F.col("a").alias("value")),
        F.struct(F.lit(4).alias("position"), F.lit("Severe AEs (≥ G3)").alias("metric"),
                 F.col("b").alias("value"))))
    cards = _stack([
        ("Total Patients", patients, F.count_if("is_active")),
        ("Active Treatments", treatments, F.count_if(F.col("status") == "active")),
        ("Total Encounters", encounters, F.count("*")),
    ]).unionByName(events.select(pairs.alias("p")).select("p.*"))
    return cards.orderBy("position").select("metric", F.col("value").cast("string").alias("value"))
