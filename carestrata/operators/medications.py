"""Prescriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carestrata.functions.scalars import as_date
from carestrata.operators.common import for_patient

_LISTED = ["drug_name", "generic_name", "ndc_code", "dosage_form", "strength", "quantity",
           "refills_remaining", "prescribed_date"]


def medication_history(medications: DataFrame, patient_id=None) -> DataFrame:
    df = medications.select("patient_id", "medication_id", *_LISTED)
    return for_patient(df, patient_id, [F.desc("prescribed_date"), F.asc("medication_id")])


def current_medications(medications: DataFrame, treatments: DataFrame, patients: DataFrame, as_of,
                        mrn: str | None = None) -> DataFrame:
    """Prescriptions in use: the treatment is active, or the prescription has not run out.

    Without an expiration date, one with refills left has not run out.
    """
    people = patients.select("patient_id", "mrn")
    if mrn is not None:
        people = people.filter(F.col("mrn") == mrn)
        medications = medications.join(people, "patient_id", "left_semi")
    running = treatments.filter(F.col("status") == "active").select(
        "treatment_id", F.lit(True).alias("running"))
    lasts = F.coalesce(F.col("expiration_date") >= as_date(as_of), F.col("refills_remaining") > 0)
    return (medications.join(running, "treatment_id", "left")
            .filter(F.coalesce("running", F.lit(False)) | lasts)
            .join(people, "patient_id")
            .select("mrn", "medication_id", *_LISTED))
