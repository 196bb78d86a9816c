"""The scorecards as their definitions read: both children joined at once, then distinct counts.

Kept for comparing results and run time with the operators; too slow to use (a × b rows per parent).
"""

from pyspark.sql import functions as F

from carestrata.functions.labels import is_serious
from carestrata.functions.scalars import mean_of, percent
from carestrata.operators.common import person_name


def _both_children(treatments, outcomes, events):
    o = outcomes.select("treatment_id", "outcome_id", "outcome_type", "baseline_value", "result_value")
    a = events.select("treatment_id", "event_id", "severity", "ctcae_grade")
    return treatments.join(o, "treatment_id", "left").join(a, "treatment_id", "left")


def _distinct_of(kind):
    return F.countDistinct(F.when(F.col("outcome_type") == kind, F.col("outcome_id")))


def efficacy_scorecard(treatments, outcomes, events):
    improved = _distinct_of("improvement")
    return (_both_children(treatments, outcomes, events).groupBy("treatment_name", "treatment_type")
            .agg(F.countDistinct("patient_id").alias("unique_patients"), improved.alias("improved"),
                 _distinct_of("stable").alias("stable"), _distinct_of("progression").alias("progression"),
                 percent(improved, F.countDistinct("outcome_id")).alias("improvement_rate_pct"),
                 F.countDistinct("event_id").alias("adverse_event_count"),
                 F.countDistinct(F.when(is_serious(), F.col("event_id"))).alias("serious_ae_count")))


def treatment_detail(treatments, outcomes, events):
    return (_both_children(treatments, outcomes, events)
            .groupBy("treatment_name", "treatment_type", "status")
            .agg(F.countDistinct("patient_id").alias("patients"),
                 F.countDistinct("outcome_id").alias("outcomes"),
                 F.countDistinct("event_id").alias("adverse_events"),
                 mean_of(F.sum("baseline_value"), F.count("baseline_value")).alias("avg_baseline"),
                 mean_of(F.sum("result_value"), F.count("result_value")).alias("avg_result")))


def provider_activity(providers, encounters, treatments):
    e = encounters.select("provider_id", "encounter_id", "patient_id")
    t = treatments.select("provider_id", "treatment_id")
    return (providers.join(e, "provider_id", "left").join(t, "provider_id", "left")
            .groupBy("provider_id", person_name().alias("provider_name"), "specialty", "department")
            .agg(F.countDistinct("encounter_id").alias("encounter_count"),
                 F.countDistinct("patient_id").alias("unique_patients"),
                 F.countDistinct("treatment_id").alias("treatments_ordered"))
            .drop("provider_id"))


def cancer_treatment_outcomes(diagnoses, treatments, outcomes):
    d = diagnoses.filter(F.col("icd10_code").startswith("C")).select(
        "patient_id", F.col("description").alias("diagnosis"))
    t = treatments.select("patient_id", "treatment_id", "treatment_name")
    o = outcomes.select("treatment_id", "outcome_type")
    return (d.join(t, "patient_id").join(o, "treatment_id", "left")
            .groupBy("diagnosis", "treatment_name", "outcome_type")
            .agg(F.countDistinct("patient_id").alias("patient_count")))
