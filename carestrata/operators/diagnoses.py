"""Conditions: status, cohorts and history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carestrata.functions.labels import band_label, band_ordinal
from carestrata.functions.scalars import completed_years, mean_of
from carestrata.operators.common import counted, for_patient, ids, named_patients
from carestrata.schema import COHORT_AGE_BANDS


def diagnoses_by_status(diagnoses: DataFrame) -> DataFrame:
    return counted(diagnoses, "status")


def diagnosis_history(diagnoses: DataFrame, patient_id=None) -> DataFrame:
    df = diagnoses.select("patient_id", "diagnosis_id", "icd10_code", "description", "status",
                          "diagnosed_date", "resolved_date")
    return for_patient(df, patient_id, [F.desc("diagnosed_date"), F.asc("diagnosis_id")])


def diagnosis_cohorts(diagnoses: DataFrame, patients: DataFrame, as_of,
                      unique_patients: bool = False) -> DataFrame:
    """Active diagnoses by code, gender and age band.

    patient_count counts diagnosis rows, so a patient diagnosed twice counts twice;
    ``unique_patients`` adds the head count next to it.
    """
    code = ["icd10_code", "description"]
    per_patient = (diagnoses.filter(F.col("status") == "active")
                   .groupBy("patient_id", *code).agg(F.count("*").alias("n")))
    band = band_ordinal(completed_years(F.col("date_of_birth"), as_of), COHORT_AGE_BANDS)
    people = patients.select("patient_id", "gender", band.alias("band"))
    measures = [F.sum("n").alias("patient_count")]
    if unique_patients:
        measures.append(F.count("*").alias("unique_patients"))
    return (per_patient.join(people, "patient_id").groupBy(*code, "gender", "band").agg(*measures)
            .orderBy(F.desc("patient_count"), *code, F.asc_nulls_last("gender"), "band")
            .withColumn("age_group", band_label(F.col("band"), COHORT_AGE_BANDS))
            .withColumnRenamed("description", "diagnosis_description")
            .select("icd10_code", "diagnosis_description", "gender", "age_group",
                    *(["patient_count", "unique_patients"] if unique_patients else ["patient_count"])))


def cohort_sizes(diagnoses: DataFrame) -> DataFrame:
    """icd10_code, description, patients (distinct), diagnoses."""
    return (diagnoses.groupBy("icd10_code", "description")
            .agg(F.countDistinct("patient_id").alias("patients"), F.count("*").alias("diagnoses"))
            .orderBy(F.desc("patients"), "icd10_code", "description"))


def cancer_gender_distribution(diagnoses: DataFrame, patients: DataFrame) -> DataFrame:
    """Distinct patients per cancer code and gender."""
    pairs = (diagnoses.filter(F.col("icd10_code").startswith("C"))
             .select("patient_id", "icd10_code", "description").distinct())
    return (pairs.join(patients.select("patient_id", "gender"), "patient_id")
            .groupBy("icd10_code", "description", "gender").agg(F.count("*").alias("patients"))
            .orderBy("icd10_code", "description", F.asc_nulls_last("gender")))


def patients_with_condition(diagnoses: DataFrame, patients: DataFrame, code_prefix: str) -> DataFrame:
    """Everyone ever diagnosed with a code under the prefix."""
    people = named_patients(patients, "mrn", "gender", "date_of_birth")
    return people.join(ids(diagnoses.filter(F.col("icd10_code").startswith(code_prefix))),
                       "patient_id", "left_semi")


def under_treatment(diagnoses: DataFrame, treatments: DataFrame, code_prefix: str) -> DataFrame:
    """patients with the condition, and how many of them have an active treatment."""
    having = ids(diagnoses.filter(F.col("icd10_code").startswith(code_prefix)))
    treated = ids(treatments.filter(F.col("status") == "active")).withColumn("treated", F.lit(1))
    return (having.join(treated, "patient_id", "left")
            .agg(F.count("*").alias("patients"), F.count("treated").alias("under_treatment")))


def time_to_treatment(diagnoses: DataFrame, treatments: DataFrame, code_prefix: str) -> DataFrame:
    """Per patient: first diagnosis under the prefix, and the first treatment from that day on."""
    first = (diagnoses.filter(F.col("icd10_code").startswith(code_prefix))
             .groupBy("patient_id").agg(F.min("diagnosed_date").alias("diagnosed")))
    # the cohort comes first: only its treatments are grouped
    starts = treatments.select("patient_id", "start_date")
    return (first.join(starts, "patient_id").filter("start_date >= diagnosed")
            .groupBy("patient_id", "diagnosed").agg(F.min("start_date").alias("first_treatment"))
            .withColumn("days_to_treatment", F.date_diff("first_treatment", "diagnosed")))


def mean_time_to_treatment(diagnoses: DataFrame, treatments: DataFrame,
                           code_prefix: str) -> DataFrame:
    waits = time_to_treatment(diagnoses, treatments, code_prefix)
    return (waits.agg(F.count("*").alias("patients"), F.sum("days_to_treatment").alias("days"))
            .select("patients", mean_of(F.col("days"), F.col("patients"), 1).alias("avg_days")))
