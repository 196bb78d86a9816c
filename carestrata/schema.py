"""The nine clinical tables: columns, keys, references, defaults and vocabularies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

STRING, DATE, TS, INT, BOOL = (
    T.StringType(), T.DateType(), T.TimestampType(), T.IntegerType(), T.BooleanType(),
)
MEASURE = T.DecimalType(10, 2)
LAB_VALUE = T.DecimalType(12, 4)


@dataclass(frozen=True)
class Table:
    """A table's columns plus the constraints that Spark itself does not enforce."""

    name: str
    key: str
    columns: dict[str, T.DataType]
    required: tuple[str, ...] = ()
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)
    max_length: dict[str, int] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([
            T.StructField(c, t, c != self.key and c not in self.required)
            for c, t in self.columns.items()
        ])


PATIENTS = Table(
    "patients", "patient_id",
    dict(patient_id=STRING, mrn=STRING, first_name=STRING, last_name=STRING, date_of_birth=DATE,
         gender=STRING, race=STRING, ethnicity=STRING, primary_language=STRING,
         insurance_type=STRING, zip_code=STRING, phone=STRING, email=STRING, is_active=BOOL,
         created_at=TS, updated_at=TS),
    required=("mrn", "first_name", "last_name", "date_of_birth"),
    defaults=dict(primary_language="English", is_active=True),
    max_length=dict(mrn=20, first_name=100, last_name=100, gender=20, race=50, ethnicity=50,
                    primary_language=50, insurance_type=50, zip_code=10, phone=20, email=150),
)
PROVIDERS = Table(
    "providers", "provider_id",
    dict(provider_id=STRING, npi=STRING, first_name=STRING, last_name=STRING, specialty=STRING,
         department=STRING, facility_name=STRING, is_active=BOOL, created_at=TS, updated_at=TS),
    required=("npi", "first_name", "last_name", "specialty"),
    defaults=dict(is_active=True),
    max_length=dict(npi=10, first_name=100, last_name=100, specialty=100, department=100,
                    facility_name=200),
)
ENCOUNTERS = Table(
    "encounters", "encounter_id",
    dict(encounter_id=STRING, patient_id=STRING, provider_id=STRING, encounter_type=STRING,
         admission_date=TS, discharge_date=TS, facility_name=STRING, chief_complaint=STRING,
         disposition=STRING, created_at=TS, updated_at=TS),
    required=("patient_id", "provider_id", "encounter_type", "admission_date"),
    references=dict(patient_id=("patients", "patient_id"), provider_id=("providers", "provider_id")),
    max_length=dict(encounter_type=50, facility_name=200, disposition=100),
)
DIAGNOSES = Table(
    "diagnoses", "diagnosis_id",
    dict(diagnosis_id=STRING, encounter_id=STRING, patient_id=STRING, icd10_code=STRING,
         description=STRING, diagnosis_type=STRING, diagnosed_date=DATE, resolved_date=DATE,
         status=STRING, created_at=TS),
    required=("encounter_id", "patient_id", "icd10_code", "description", "diagnosis_type",
              "diagnosed_date"),
    references=dict(encounter_id=("encounters", "encounter_id"),
                    patient_id=("patients", "patient_id")),
    defaults=dict(status="active"),
    max_length=dict(icd10_code=10, diagnosis_type=20, status=20),
)
TREATMENTS = Table(
    "treatments", "treatment_id",
    dict(treatment_id=STRING, encounter_id=STRING, patient_id=STRING, provider_id=STRING,
         treatment_type=STRING, treatment_name=STRING, cpt_code=STRING, start_date=DATE,
         end_date=DATE, dosage=STRING, frequency=STRING, route=STRING, status=STRING,
         notes=STRING, created_at=TS, updated_at=TS),
    required=("encounter_id", "patient_id", "provider_id", "treatment_type", "treatment_name",
              "start_date"),
    references=dict(encounter_id=("encounters", "encounter_id"),
                    patient_id=("patients", "patient_id"),
                    provider_id=("providers", "provider_id")),
    defaults=dict(status="active"),
    max_length=dict(treatment_type=50, treatment_name=300, cpt_code=10, dosage=100, frequency=100,
                    route=50, status=20),
)
MEDICATIONS = Table(
    "medications", "medication_id",
    dict(medication_id=STRING, treatment_id=STRING, patient_id=STRING, ndc_code=STRING,
         drug_name=STRING, generic_name=STRING, dosage_form=STRING, strength=STRING, quantity=INT,
         refills_remaining=INT, prescribed_date=DATE, expiration_date=DATE, prescriber_id=STRING,
         created_at=TS),
    required=("patient_id", "drug_name", "prescribed_date"),
    references=dict(treatment_id=("treatments", "treatment_id"),
                    patient_id=("patients", "patient_id"),
                    prescriber_id=("providers", "provider_id")),
    defaults=dict(refills_remaining=0),
    max_length=dict(ndc_code=15, drug_name=300, generic_name=300, dosage_form=100, strength=100),
)
OUTCOMES = Table(
    "treatment_outcomes", "outcome_id",
    dict(outcome_id=STRING, treatment_id=STRING, patient_id=STRING, outcome_type=STRING,
         outcome_measure=STRING, baseline_value=MEASURE, result_value=MEASURE, unit=STRING,
         assessment_date=DATE, assessed_by=STRING, notes=STRING, created_at=TS),
    required=("treatment_id", "patient_id", "outcome_type", "assessment_date"),
    references=dict(treatment_id=("treatments", "treatment_id"),
                    patient_id=("patients", "patient_id"),
                    assessed_by=("providers", "provider_id")),
    max_length=dict(outcome_type=50, outcome_measure=200, unit=50),
)
ADVERSE_EVENTS = Table(
    "adverse_events", "event_id",
    dict(event_id=STRING, treatment_id=STRING, patient_id=STRING, event_type=STRING,
         severity=STRING, ctcae_grade=INT, onset_date=DATE, resolution_date=DATE,
         action_taken=STRING, outcome=STRING, reported_by=STRING, created_at=TS),
    required=("treatment_id", "patient_id", "event_type", "severity", "onset_date"),
    references=dict(treatment_id=("treatments", "treatment_id"),
                    patient_id=("patients", "patient_id"),
                    reported_by=("providers", "provider_id")),
    max_length=dict(event_type=100, severity=20, action_taken=200, outcome=100),
)
LAB_RESULTS = Table(
    "lab_results", "lab_id",
    dict(lab_id=STRING, encounter_id=STRING, patient_id=STRING, test_name=STRING,
         loinc_code=STRING, result_value=LAB_VALUE, result_text=STRING, unit=STRING,
         reference_low=LAB_VALUE, reference_high=LAB_VALUE, abnormal_flag=STRING,
         collected_date=TS, resulted_date=TS, ordering_provider=STRING, created_at=TS),
    required=("patient_id", "test_name", "collected_date"),
    references=dict(encounter_id=("encounters", "encounter_id"),
                    patient_id=("patients", "patient_id"),
                    ordering_provider=("providers", "provider_id")),
    max_length=dict(test_name=200, loinc_code=20, result_text=500, unit=50, abnormal_flag=5),
)

TABLES: dict[str, Table] = {
    t.name: t
    for t in (PATIENTS, PROVIDERS, ENCOUNTERS, DIAGNOSES, TREATMENTS, MEDICATIONS, OUTCOMES,
              ADVERSE_EVENTS, LAB_RESULTS)
}

# Vocabularies of the coded columns.
GENDERS = ["Male", "Female", "Other"]
RACES = ["White", "Black or African American", "Asian", "Other"]
ETHNICITIES = ["Not Hispanic", "Hispanic/Latino"]
INSURANCE_TYPES = ["Medicare", "Commercial", "Medicaid", "Self-pay"]
ENCOUNTER_TYPES = ["inpatient", "outpatient", "emergency", "telehealth"]
DISPOSITIONS = ["discharged", "transferred", "admitted", "expired"]
DIAGNOSIS_TYPES = ["primary", "secondary", "admitting"]
DIAGNOSIS_STATUSES = ["active", "resolved", "chronic"]
TREATMENT_TYPES = ["medication", "procedure", "therapy", "surgery"]
TREATMENT_STATUSES = ["active", "completed", "discontinued"]
ROUTES = ["oral", "IV", "subcutaneous", "topical", "intramuscular", "other"]
OUTCOME_TYPES = ["remission", "improvement", "stable", "progression", "adverse"]
SEVERITIES = ["mild", "moderate", "severe", "life-threatening"]
SERIOUS_SEVERITIES = ["severe", "life-threatening"]
AE_OUTCOMES = ["resolved", "ongoing", "fatal"]
ABNORMAL_FLAGS = ["N", "H", "L", "HH", "LL"]
FLAG_LABELS = {"N": "Normal", "H": "High", "L": "Low", "HH": "Critical High", "LL": "Critical Low"}

# Graph node sizes and colours by kind, in drawing order.
NODE_STYLE = {
    "patient": (30, "#3498db"),
    "encounter": (18, "#2ecc71"),
    "diagnosis": (18, "#9b59b6"),
    "treatment": (20, "#e67e22"),
    "outcome": (14, "#1abc9c"),
    "adverse_event": (16, "#e74c3c"),
}

# Fixed values: (exclusive upper age, label); None closes the list.
AGE_BANDS = [(40, "< 40"), (55, "40–54"), (65, "55–64"), (75, "65–74"), (None, "75+")]
COHORT_AGE_BANDS = [(55, "< 55"), (65, "55–64"), (75, "65–74"), (None, "75+")]
