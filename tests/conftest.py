import datetime as dt
import os
import sys
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from carestrata.plans.session import configure  # noqa: E402
from carestrata.sources.tables import literal_rows  # noqa: E402

AS_OF = "2025-08-01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("carestrata-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.log.level", "ERROR")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate())
    yield configure(session)
    session.stop()


def d(text):
    return dt.date.fromisoformat(text) if text else None


def ts(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc) if text else None


def dec(text):
    return None if text is None else Decimal(text)


@pytest.fixture(scope="session")
def clinic(spark):
    """A clinic small enough to count by hand: NULLs, ties, zero baselines, a leap-day birth."""
    def rows(name, *items):
        return literal_rows(spark, name, items)

    return {
        "patients": rows(
            "patients",
            dict(patient_id="p1", mrn="M-1", first_name="Ida", last_name="Holm", gender="Female",
                 date_of_birth=d("2000-02-29"), insurance_type="Medicare", zip_code="10"),
            dict(patient_id="p2", mrn="M-2", first_name="Ole", last_name="Holm", gender="Male",
                 date_of_birth=d("1950-08-02"), zip_code="10"),
            dict(patient_id="p3", mrn="M_3", first_name="Pia", last_name="Lund", gender="Female",
                 date_of_birth=d("1940-01-01"), insurance_type="Medicare", zip_code="20",
                 is_active=False),
            dict(patient_id="p4", mrn="M-4", first_name="Kai", last_name="Berg", gender="Male",
                 date_of_birth=d("1985-08-01"), insurance_type="Medicaid")),
        "providers": rows(
            "providers",
            dict(provider_id="v1", npi="1", first_name="Ann", last_name="Vik", department="Cancer Center",
                 specialty="Medical Oncology"),
            dict(provider_id="v2", npi="2", first_name="Bo", last_name="Dahl", specialty="Cardiology"),
            dict(provider_id="v3", npi="3", first_name="Cy", last_name="Moe", specialty="Cardiology",
                 is_active=False)),
        "encounters": rows(
            "encounters",
            dict(encounter_id="e1", patient_id="p1", provider_id="v1", encounter_type="inpatient",
                 admission_date=ts("2025-01-01T08:00"), discharge_date=ts("2025-01-05T10:00"),
                 chief_complaint="Stage IIIA disease"),
            dict(encounter_id="e2", patient_id="p1", provider_id="v1", encounter_type="inpatient",
                 admission_date=ts("2025-02-04T09:00"), discharge_date=ts("2025-02-04T18:00")),
            dict(encounter_id="e3", patient_id="p1", provider_id="v2", encounter_type="inpatient",
                 admission_date=ts("2025-03-08T09:00"), discharge_date=ts("2025-03-09T09:00")),
            dict(encounter_id="e4", patient_id="p2", provider_id="v2", encounter_type="outpatient",
                 admission_date=ts("2025-07-01T09:00"))),
        "diagnoses": rows(
            "diagnoses",
            dict(diagnosis_id="d1", encounter_id="e1", patient_id="p1", icd10_code="C34.90",
                 description="Lung", diagnosis_type="primary", diagnosed_date=d("2025-01-02")),
            dict(diagnosis_id="d2", encounter_id="e2", patient_id="p1", icd10_code="C34.90",
                 description="Lung", diagnosis_type="primary", diagnosed_date=d("2025-02-04")),
            dict(diagnosis_id="d3", encounter_id="e2", patient_id="p1", icd10_code="E11.9",
                 description="Type 2 diabetes", diagnosis_type="secondary", status="chronic",
                 diagnosed_date=d("2025-02-04")),
            dict(diagnosis_id="d4", encounter_id="e4", patient_id="p2", icd10_code="c10",
                 description="Not cancer", diagnosis_type="primary", diagnosed_date=d("2025-07-01"))),
        "treatments": rows(
            "treatments",
            dict(treatment_id="t1", encounter_id="e1", patient_id="p1", provider_id="v1",
                 treatment_type="medication", treatment_name="Drug A", start_date=d("2025-01-10"),
                 end_date=d("2025-01-20"), status="completed"),
            dict(treatment_id="t2", encounter_id="e2", patient_id="p1", provider_id="v1",
                 treatment_type="medication", treatment_name="Drug A", start_date=d("2025-01-20")),
            dict(treatment_id="t3", encounter_id="e4", patient_id="p2", provider_id="v2",
                 treatment_type="therapy", treatment_name="Therapy's end", start_date=d("2025-07-01"),
                 status=None)),
        "medications": rows(
            "medications",
            dict(medication_id="m1", treatment_id="t2", patient_id="p1", drug_name="A",
                 prescribed_date=d("2025-01-20"), refills_remaining=0),
            dict(medication_id="m2", treatment_id=None, patient_id="p2", drug_name="B",
                 prescribed_date=d("2025-07-01"), refills_remaining=3,
                 expiration_date=d("2025-07-15")),
            dict(medication_id="m3", treatment_id=None, patient_id="p2", drug_name="C",
                 prescribed_date=d("2025-07-01"), refills_remaining=1)),
        "treatment_outcomes": rows(
            "treatment_outcomes",
            dict(outcome_id="o1", treatment_id="t1", patient_id="p1", outcome_type="improvement",
                 outcome_measure="RECIST 1.1 (target lesion)", baseline_value=dec("45.00"),
                 result_value=dec("31.50"), assessment_date=d("2025-02-01")),
            dict(outcome_id="o2", treatment_id="t1", patient_id="p1", outcome_type="stable",
                 baseline_value=None, result_value=dec("10.00"), assessment_date=d("2025-03-01")),
            dict(outcome_id="o3", treatment_id="t2", patient_id="p1", outcome_type="improvement",
                 outcome_measure="RECIST 1.1", baseline_value=dec("0.00"), result_value=dec("1.00"),
                 assessment_date=d("2025-03-01"))),
        "adverse_events": rows(
            "adverse_events",
            dict(event_id="a1", treatment_id="t1", patient_id="p1", event_type="Rash",
                 severity="mild", ctcae_grade=3, onset_date=d("2025-01-12"),
                 resolution_date=d("2025-01-14"), action_taken="Dose Reduced"),
            dict(event_id="a2", treatment_id="t1", patient_id="p1", event_type="Rash",
                 severity="mild", ctcae_grade=3, onset_date=d("2025-01-15"),
                 resolution_date=d("2025-01-16"), action_taken="none"),
            dict(event_id="a3", treatment_id="t1", patient_id="p1", event_type="Rash",
                 severity="mild", ctcae_grade=None, onset_date=d("2025-01-16")),
            dict(event_id="a4", treatment_id="t2", patient_id="p1", event_type="Fever",
                 severity="life-threatening", ctcae_grade=2, onset_date=d("2025-02-01"))),
        "lab_results": rows(
            "lab_results",
            *[dict(lab_id=f"l{i}", patient_id="p1", test_name="HbA1c", result_value=dec(v),
                   reference_low=dec(low), abnormal_flag=flag, collected_date=ts(at))
              for i, (v, low, flag, at) in enumerate([
                  ("9.2000", None, "HH", "2025-01-08T08:00"), ("7.8000", "4.0000", "H", "2025-01-08T08:00"),
                  (None, "5.0000", None, "2025-01-08T09:30"), ("6.9000", "4.0000", "N", "2025-07-15T08:00")])]),
    }
