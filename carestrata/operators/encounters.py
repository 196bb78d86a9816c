"""Visits: volumes, history, workload, frequent visitors and readmissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carestrata.functions.bounds import in_days
from carestrata.functions.scalars import as_date, days_between, mean_of, percent
from carestrata.operators.common import counted, for_patient, named_patients, person_name, top_with


def encounters_by_type(encounters: DataFrame) -> DataFrame:
    return counted(encounters, "encounter_type")


def recent_encounters(encounters: DataFrame, patients: DataFrame, providers: DataFrame,
                      k: int = 20) -> DataFrame:
    order = [F.desc("admission_date"), F.asc("encounter_id")]
    listed = encounters.select("encounter_id", "patient_id", "provider_id", "encounter_type",
                               "admission_date", "disposition")
    return (top_with(listed, order, k, (named_patients(patients, "mrn"), "patient_id"),
                     (providers.select("provider_id", person_name().alias("provider_name")),
                      "provider_id"))
            .select("encounter_id", "mrn", "patient_name", "provider_name", "encounter_type",
                    "admission_date", "disposition"))


def encounter_history(encounters: DataFrame, providers: DataFrame, patient_id=None) -> DataFrame:
    """Every visit with its provider; newest first when one patient is asked for."""
    df = encounters.join(providers.select("provider_id", person_name().alias("provider"), "specialty"),
                         "provider_id")
    df = df.select("patient_id", "encounter_id", "encounter_type", "admission_date",
                   "discharge_date", "disposition", "provider", "specialty")
    return for_patient(df, patient_id, [F.desc("admission_date"), F.asc("encounter_id")])


def department_volume(encounters: DataFrame, providers: DataFrame) -> DataFrame:
    """department, encounter_count: visits are summed per provider before the join."""
    visits = encounters.groupBy("provider_id").agg(F.count("*").alias("n"))
    return (visits.join(providers.select("provider_id", "department"), "provider_id")
            .groupBy("department").agg(F.sum("n").alias("encounter_count"))
            .orderBy(F.desc("encounter_count"), F.asc_nulls_last("department")))


def specialty_workload(encounters: DataFrame, providers: DataFrame) -> DataFrame:
    """Encounters per provider by specialty; providers without a visit count as 0."""
    visits = encounters.groupBy("provider_id").agg(F.count("*").alias("n"))
    per_provider = (providers.select("provider_id", "specialty")
                    .join(visits, "provider_id", "left").na.fill(0, ["n"]))
    return (per_provider.groupBy("specialty")
            .agg(F.count("*").alias("providers"), F.sum("n").alias("encounters"),
                 F.max("n").alias("busiest_provider"))
            .withColumn("encounters_per_provider", mean_of(F.col("encounters"), F.col("providers"), 1))
            .orderBy(F.desc("encounters_per_provider"), "specialty"))


def frequent_visitors(encounters: DataFrame, patients: DataFrame, as_of, months: int = 6,
                      k: int = 20) -> DataFrame:
    """Patients with the most encounters in the months up to ``as_of``."""
    end = as_date(as_of)
    recent = in_days(encounters, "admission_date", F.add_months(end, -months), F.date_add(end, 1))
    order = [F.desc("encounter_count"), F.asc("patient_id")]
    visits = recent.groupBy("patient_id").agg(
        F.count("*").alias("encounter_count"), F.max("admission_date").alias("last_admission"))
    return (top_with(visits, order, k, (named_patients(patients, "mrn"), "patient_id"))
            .select("patient_id", "mrn", "patient_name", "encounter_count", "last_admission"))


def readmissions(encounters: DataFrame, within_days: int = 30) -> DataFrame:
    """Each inpatient stay with a discharge, and whether another followed within the days.

    A readmission is any other inpatient admission from the day of discharge on. Admissions are
    counted per patient and day first; the window then runs over days, at most a lifetime of them.
    """
    stays = (encounters.filter((F.col("encounter_type") == "inpatient")
                               & F.col("discharge_date").isNotNull())
             .select("encounter_id", "patient_id", F.to_date("admission_date").alias("admitted"),
                     F.to_date("discharge_date").alias("day")))
    inpatient = encounters.filter(F.col("encounter_type") == "inpatient")
    days = (inpatient.select("patient_id", F.to_date("admission_date").alias("day"),
                             F.lit(1).alias("n"))
            .unionByName(stays.select("patient_id", "day", F.lit(0).alias("n")))
            .groupBy("patient_id", "day").agg(F.sum("n").alias("n")))
    ahead = (Window.partitionBy("patient_id").orderBy(F.unix_date("day"))
             .rangeBetween(Window.currentRow, within_days))
    admissions = days.select("patient_id", "day", F.sum("n").over(ahead).alias("n"))
    itself = F.when(days_between("admitted", "day").between(0, within_days), 1).otherwise(0)
    return (stays.join(admissions, ["patient_id", "day"])
            .select("encounter_id", "patient_id", "admitted", F.col("day").alias("discharged"),
                    (F.col("n") - itself > 0).alias("readmitted")))


def readmission_rates(encounters: DataFrame, diagnoses: DataFrame,
                      within_days: int = 30) -> DataFrame:
    """icd10_code, description, stays, readmitted, readmission_rate_pct."""
    coded = diagnoses.select("encounter_id", "icd10_code", "description")
    stays = readmissions(encounters, within_days).select("encounter_id", "readmitted")
    # only the diagnoses of inpatient stays are made distinct
    return (stays.join(coded, "encounter_id").distinct()
            .groupBy("icd10_code", "description")
            .agg(F.count("*").alias("stays"), F.count_if("readmitted").alias("readmitted"))
            .withColumn("readmission_rate_pct", percent(F.col("readmitted"), F.col("stays")))
            .orderBy(F.desc("readmission_rate_pct"), "icd10_code", "description"))
