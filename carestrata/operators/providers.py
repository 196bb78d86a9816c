"""Provider activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carestrata.operators.common import person_name


def provider_activity(providers: DataFrame, encounters: DataFrame, treatments: DataFrame,
                      by: str = "encounter_count") -> DataFrame:
    """Encounters, distinct patients and treatments of every provider.

    Encounters and treatments only share the provider; each is summed per provider on its own
    instead of being multiplied with the other.
    """
    visits = encounters.groupBy("provider_id").agg(
        F.count("*").alias("encounter_count"), F.countDistinct("patient_id").alias("unique_patients"))
    orders = treatments.groupBy("provider_id").agg(F.count("*").alias("treatments_ordered"))
    measures = ["encounter_count", "unique_patients", "treatments_ordered"]
    return (providers.select("provider_id", person_name().alias("provider_name"), "specialty", "department")
            .join(visits, "provider_id", "left").join(orders, "provider_id", "left")
            .na.fill(0, measures)
            .orderBy(F.desc(by), "provider_id")
            .select("provider_name", "specialty", "department", *measures))


def actively_treating(treatments: DataFrame) -> DataFrame:
    """How many providers have an active treatment."""
    return (treatments.filter(F.col("status") == "active")
            .agg(F.countDistinct("provider_id").alias("providers"),
                 F.count("*").alias("active_treatments")))
