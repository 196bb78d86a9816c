"""Short lists that fill a form or a selection box."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carestrata.functions.scalars import utc_text
from carestrata.operators.common import named_patients, one_value, person_name, top_with


def treatment_type_choices(treatments: DataFrame) -> DataFrame:
    return one_value(treatments, "treatment_type")


def event_type_choices(adverse_events: DataFrame) -> DataFrame:
    return one_value(adverse_events, "event_type")


def test_choices(labs: DataFrame, patient_id=None) -> DataFrame:
    """All test names, or those of one patient."""
    return one_value(labs if patient_id is None else
                     labs.filter(F.col("patient_id") == F.lit(patient_id)), "test_name")


test_choices.__test__ = False


def active_patients(patients: DataFrame) -> DataFrame:
    return (patients.filter("is_active").orderBy("last_name", "first_name", "mrn")
            .select("patient_id", "mrn", person_name().alias("name")))


def active_providers(providers: DataFrame) -> DataFrame:
    return (providers.filter("is_active").orderBy("last_name", "first_name", "npi")
            .select("provider_id", person_name().alias("name"), "specialty"))


def encounter_choices(encounters: DataFrame, patients: DataFrame, k: int = 50) -> DataFrame:
    """Latest encounters with the keys a diagnosis, treatment or lab entry takes from them."""
    order = [F.desc("admission_date"), F.asc("encounter_id")]
    listed = encounters.select("encounter_id", "patient_id", "provider_id", "encounter_type",
                               "admission_date")
    return (top_with(listed, order, k, (named_patients(patients, "mrn"), "patient_id"))
            .select("encounter_id", "patient_id", "provider_id", "mrn", "patient_name",
                    "encounter_type", utc_text(F.col("admission_date")).alias("adm")))


def active_treatment_choices(treatments: DataFrame, patients: DataFrame, k: int = 50) -> DataFrame:
    order = [F.desc("start_date"), F.asc("treatment_id")]
    running = (treatments.filter(F.col("status") == "active")
               .select("treatment_id", "patient_id", "treatment_name", "start_date"))
    return (top_with(running, order, k, (named_patients(patients, "mrn"), "patient_id"))
            .select("treatment_id", "patient_id", "treatment_name", "mrn", "patient_name"))


def latest_patients(patients: DataFrame, k: int = 5) -> DataFrame:
    return (patients.orderBy(F.desc("created_at"), "mrn").limit(k)
            .select("mrn", person_name().alias("name"), "gender", "insurance_type", "created_at"))


def latest_encounters(encounters: DataFrame, patients: DataFrame, k: int = 5) -> DataFrame:
    order = [F.desc("created_at"), F.asc("encounter_id")]
    listed = encounters.select("encounter_id", "patient_id", "encounter_type", "admission_date",
                               "created_at")
    return (top_with(listed, order, k, (named_patients(patients, "mrn"), "patient_id"))
            .select("mrn", "patient_name", "encounter_type", "admission_date", "created_at"))
