"""Who the patients are: distributions, search, and population breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carestrata.functions.labels import band_label, band_ordinal
from carestrata.functions.predicates import patient_search
from carestrata.functions.scalars import completed_years
from carestrata.functions.series import report_rank
from carestrata.operators.common import counted, for_patient, ids, person_name
from carestrata.schema import AGE_BANDS


def active(patients: DataFrame) -> DataFrame:
    return patients.filter("is_active")


def age_distribution(patients: DataFrame, as_of) -> DataFrame:
    """age_group, patient_count of active patients, youngest band first."""
    band = band_ordinal(completed_years(F.col("date_of_birth"), as_of), AGE_BANDS)
    return (active(patients).groupBy(band.alias("band")).agg(F.count("*").alias("patient_count"))
            .orderBy("band")
            .select(band_label(F.col("band"), AGE_BANDS).alias("age_group"), "patient_count"))


def gender_distribution(patients: DataFrame) -> DataFrame:
    return counted(active(patients), "gender", "patient_count")


def insurance_mix(patients: DataFrame) -> DataFrame:
    return counted(active(patients), "insurance_type", "patient_count")


def patients_by_insurance(patients: DataFrame) -> DataFrame:
    return counted(active(patients), "insurance_type")


def search_patients(patients: DataFrame, term: str, k: int = 50) -> DataFrame:
    """Active patients whose name or MRN contains the term, by last and first name."""
    return (active(patients).filter(patient_search(term))
            .orderBy("last_name", "first_name", "mrn").limit(k)
            .select("patient_id", "mrn", person_name().alias("patient_name"), "date_of_birth", "gender",
                    "insurance_type"))


def demographics(patients: DataFrame, as_of, patient_id=None) -> DataFrame:
    df = patients.select(
        "patient_id", "mrn", "first_name", "last_name", "date_of_birth", "gender", "race",
        "ethnicity", "insurance_type", "zip_code",
        completed_years(F.col("date_of_birth"), as_of).alias("age"))
    return for_patient(df, patient_id, ["patient_id"])


def population_breakdown(patients: DataFrame, as_of) -> DataFrame:
    """Active patients by age group × insurance with every subtotal.

    all_ages / all_insurance are 1 on the subtotal rows, which tells them from a NULL insurance.
    """
    band = band_ordinal(completed_years(F.col("date_of_birth"), as_of), AGE_BANDS)
    return (active(patients).withColumn("band", band)
            .cube("band", "insurance_type")
            .agg(F.count("*").alias("patient_count"),
                 F.grouping("band").cast("int").alias("all_ages"),
                 F.grouping("insurance_type").cast("int").alias("all_insurance"))
            .orderBy("all_ages", "band", "all_insurance", F.asc_nulls_last("insurance_type"))
            .select(F.when(F.col("all_ages") == 0, band_label(F.col("band"), AGE_BANDS)).alias("age_group"),
                    "insurance_type", "patient_count", "all_ages", "all_insurance"))


def zip_ranking(patients: DataFrame) -> DataFrame:
    """zip_code, patient_count, rank (ties share a rank)."""
    per_zip = patients.groupBy("zip_code").agg(F.count("*").alias("patient_count"))
    return report_rank(per_zip, "patient_count").orderBy("rank", F.asc_nulls_last("zip_code"))


def older_patients_with_active_cancer(patients: DataFrame, diagnoses: DataFrame, as_of,
                                      over_age: int = 70) -> DataFrame:
    """Patients over an age who have an active cancer diagnosis."""
    cancer = ids(diagnoses.filter((F.col("status") == "active") & F.col("icd10_code").startswith("C")))
    age = completed_years(F.col("date_of_birth"), as_of)
    return (patients.withColumn("age", age).filter(F.col("age") > over_age)
            .join(cancer, "patient_id", "left_semi")
            .select("patient_id", "mrn", person_name().alias("patient_name"), "age", "gender"))
