import pytest
from pyspark.sql import functions as F

from carestrata.operators import ingest
from carestrata.schema import TABLES
from carestrata.streaming.entry import recorded
from tests.conftest import d, dec


def _reasons(checked):
    return {r.submission_id: r.reason for r in checked.collect()}


def _patients(spark, *rows):
    columns = ("submission_id mrn first_name last_name date_of_birth gender race ethnicity insurance_type"
               " zip_code").split()
    types = ", ".join(f"{c} {'date' if c == 'date_of_birth' else 'string'}" for c in columns)
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], types)


def _person(n, mrn, **more):
    return dict(dict(submission_id=n, mrn=mrn, first_name="A", last_name="B", gender="Other",
                     date_of_birth=d("1970-01-01")), **more)


def test_patients(spark, clinic):
    batch = _patients(
        spark,
        _person("01", "N-1", zip_code=" "), _person("02", "N-1"), _person("03", "N-1", first_name=""),
        _person("04", "M-1"), _person("05", None), _person("06", "N-2", date_of_birth=d("1919-12-31")),
        _person("07", "N-3", date_of_birth=d("2025-08-02")), _person("08", "N-4", gender="Unknown"),
        _person("09", "N" * 21), _person("10", "N-5", date_of_birth=d("1920-01-01")),
        _person("11", "N-6", date_of_birth=None))
    checked = ingest.ingest_patients(batch, clinic["patients"], "2025-08-01")
    assert _reasons(checked) == {
        "01": None, "02": "mrn already in use", "03": "first_name is required", "04": "mrn already in use",
        "05": "mrn is required", "06": "date_of_birth out of range", "07": "date_of_birth out of range",
        "08": "gender not in list", "09": "mrn too long", "10": None, "11": "date_of_birth is required"}
    rows = ingest.accepted(checked)
    assert rows.columns == list(TABLES["patients"].columns)
    first = rows.filter("mrn = 'N-1'").first()
    assert (first.zip_code, first.primary_language, first.is_active) == (None, "English", True)
    assert first.created_at is not None and len(first.patient_id) == 36
    assert ingest.rejected(checked).count() == 9


def test_many_copies_of_one_row(spark, clinic):
    copies = spark.range(5000).select(
        F.lpad(F.col("id").cast("string"), 6, "0").alias("submission_id"), F.lit("SAME").alias("mrn"),
        F.lit("A").alias("first_name"), F.lit("B").alias("last_name"),
        F.lit("1970-01-01").cast("date").alias("date_of_birth"))
    checked = ingest.ingest_patients(copies, clinic["patients"], "2025-08-01")
    assert [r.submission_id for r in checked.filter("reason is null").collect()] == ["000000"]
    assert checked.count() == 5000


def test_encounters(spark, clinic):
    batch = spark.createDataFrame([
        ("1", "p1", "v1", "inpatient", d("2025-08-01"), " ", "admitted"),
        ("2", "nobody", "v1", "inpatient", d("2025-08-01"), "x", None),
        ("3", "p1", None, "inpatient", d("2025-08-01"), "x", None),
        ("4", "p1", "v1", "visit", d("2025-08-01"), "x", None),
        ("5", "p1", "v1", "inpatient", None, "x", None)],
        "submission_id string, patient_id string, provider_id string, encounter_type string,"
        " admission_date date, chief_complaint string, disposition string")
    checked = ingest.ingest_encounters(batch, clinic["patients"], clinic["providers"])
    assert _reasons(checked) == {"1": None, "2": "unknown patient", "3": "unknown provider",
                                 "4": "encounter_type not in list", "5": "admission_date is required"}
    row = ingest.accepted(checked).first()
    assert row.chief_complaint is None and row.admission_date.hour == 0


def test_diagnoses_take_the_patient_from_the_encounter(spark, clinic):
    batch = spark.createDataFrame([("1", "e4", "I10", "Hypertension", "primary", d("2025-08-01"), None),
                                   ("2", "e4", "I10", "", "primary", d("2025-08-01"), None),
                                   ("3", "e9", "I10", "x", "primary", d("2025-08-01"), None)],
                                  "submission_id string, encounter_id string, icd10_code string, description string,"
                                  " diagnosis_type string, diagnosed_date date, status string")
    checked = ingest.ingest_diagnoses(batch, clinic["encounters"])
    assert _reasons(checked) == {"1": None, "2": "description is required", "3": "unknown encounter"}
    row = ingest.accepted(checked).first()
    assert (row.patient_id, row.status) == ("p2", "active")


def test_treatments_take_patient_and_provider_from_the_encounter(spark, clinic):
    batch = spark.createDataFrame([("1", "e4", "medication", "X", d("2025-08-01"), "", " ", "other", "active"),
                                   ("2", "e4", "medication", None, d("2025-08-01"), "", "", "oral", "active"),
                                   ("3", "e4", "medication", "X", d("2025-08-01"), "", "", "nasal", "active")],
                                  "submission_id string, encounter_id string, treatment_type string,"
                                  " treatment_name string, start_date date, dosage string, frequency string,"
                                  " route string, status string")
    checked = ingest.ingest_treatments(batch, clinic["encounters"])
    assert _reasons(checked) == {"1": None, "2": "treatment_name is required", "3": "route not in list"}
    row = ingest.accepted(checked).first()
    assert (row.patient_id, row.provider_id, row.dosage, row.frequency) == ("p2", "v2", None, None)


def test_labs_zero_limit(spark, clinic):
    batch = spark.createDataFrame([("1", "e1", "LDL", dec("0.0000"), d("2025-08-01")),
                                   ("2", "e1", "", dec("1.0000"), d("2025-08-01"))],
                                  "submission_id string, encounter_id string, test_name string,"
                                  " reference_low decimal(12,4), collected_date date")
    kept = ingest.ingest_labs(batch, clinic["encounters"])
    assert _reasons(kept) == {"1": None, "2": "test_name is required"}
    row = ingest.accepted(kept).first()
    assert (row.patient_id, row.reference_low, row.collected_date.hour) == ("p1", dec("0.0000"), 0)
    dropped = ingest.ingest_labs(batch, clinic["encounters"], zero_reference_is_missing=True)
    assert ingest.accepted(dropped).first().reference_low is None


@pytest.mark.parametrize("grade, reason", [(1, None), (5, None), (None, None), (0, "ctcae_grade out of range"),
                                           (6, "ctcae_grade out of range")])
def test_adverse_event_grades(spark, clinic, grade, reason):
    batch = spark.createDataFrame([("1", "t3", "Rash", "mild", grade, d("2025-08-01"), "ongoing")],
                                  "submission_id string, treatment_id string, event_type string, severity string,"
                                  " ctcae_grade int, onset_date date, outcome string")
    checked = ingest.ingest_adverse_events(batch, clinic["treatments"])
    assert _reasons(checked) == {"1": reason}
    assert checked.first().patient_id == "p2"


def test_recording_a_batch_again_changes_nothing(spark, clinic, tmp_path):
    batch = _patients(spark, _person("1", "N-1"), _person("2", "M-1"))
    out = str(tmp_path / "patients")
    for _ in range(2):
        checked = ingest.ingest_patients(batch, clinic["patients"], "2025-08-01")
        ingest.record(checked, out, 0)
    assert recorded(spark, out).count() == 1 and recorded(spark, out, "rejected").count() == 1
    assert recorded(spark, out, before_batch=0).count() == 0
    again = ingest.ingest_patients(_patients(spark, _person("3", "N-1")), recorded(spark, out), "2025-08-01")
    assert _reasons(again) == {"3": "mrn already in use"}
