"""The committed store: appends, constraints, and what date and flag questions read of it."""

import re

import pytest
from pyspark.sql import functions as F

from carestrata.functions.bounds import in_days
from carestrata.operators import encounters, labs, safety
from carestrata.schema import TABLES
from carestrata.sources.files import SharedFiles
from carestrata.sources.store import ClinicStore, ConstraintError
from carestrata.sources.tables import literal_rows
from tests.comparing import rows_of
from tests.conftest import ts


@pytest.fixture(scope="module")
def store(spark, clinic, tmp_path_factory):
    made = ClinicStore(spark, str(tmp_path_factory.mktemp("store")))
    for name in TABLES:
        made.append(name, clinic[name], "base")
    return made


def lab(spark, lab_id, **more):
    return literal_rows(spark, "lab_results", [dict(
        dict(lab_id=lab_id, patient_id="p1", test_name="HbA1c", collected_date=ts("2024-05-01T00:00")), **more)])


def test_everything_comes_back_with_declared_types(store, clinic):
    for name, df in clinic.items():
        back = store.load(name)
        assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in TABLES[name].schema]
        assert rows_of(back) == rows_of(df)


def test_an_append_counts_once(spark, clinic, tmp_path):
    store = ClinicStore(spark, str(tmp_path))
    assert store.load("patients").count() == 0
    assert store.append("patients", clinic["patients"], "a") == 4
    assert store.append("patients", clinic["patients"], "a") == 4  # repeated: nothing changes
    assert ClinicStore(spark, str(tmp_path)).append("patients", clinic["patients"].limit(1), "a") == 4
    assert store.append("patients", clinic["patients"].filter("false"), "empty") == 0
    assert store.load("patients").count() == 4
    assert [c["append"] for c in store.commits("patients")] == ["a", "empty"]


def test_rows_without_a_commit_are_not_read(spark, clinic, tmp_path, monkeypatch):
    store = ClinicStore(spark, str(tmp_path))
    store.append("patients", clinic["patients"].filter("patient_id = 'p1'"), "a")
    with monkeypatch.context() as broken:  # dies between rows and commit
        broken.setattr(SharedFiles, "put_new", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            store.append("patients", clinic["patients"].filter("patient_id = 'p2'"), "b")
    assert store.load("patients").count() == 1
    assert store.append("patients", clinic["patients"].filter("patient_id = 'p2'"), "b") == 1
    assert sorted(r.patient_id for r in store.load("patients").collect()) == ["p1", "p2"]


def test_the_first_of_two_commits_counts(spark, clinic, tmp_path, monkeypatch):
    store, other = ClinicStore(spark, str(tmp_path)), ClinicStore(spark, str(tmp_path))
    checked = ClinicStore._checked

    def slow(self, name, written, enforce):
        if self is store:
            other.append("patients", clinic["patients"].filter("patient_id = 'p1'"), "a")
        return checked(self, name, written, enforce)

    monkeypatch.setattr(ClinicStore, "_checked", slow)
    assert store.append("patients", clinic["patients"], "a") == 1
    assert [r.patient_id for r in store.load("patients").collect()] == ["p1"]
    assert len(store.files.names(f"{tmp_path}/rows/patients")) == 1


@pytest.mark.parametrize("change,said", [
    (dict(patient_id="nobody"), "1 rows with a patient_id that is not in patients"),
    (dict(ordering_provider="nobody"), "ordering_provider that is not in providers"),
    (dict(lab_id="l1"), "1 rows with a lab_id that is taken"),
    (dict(test_name=None), "1 rows without test_name"),
])
def test_broken_constraints_leave_nothing(spark, store, change, said):
    row = lab(spark, "new").select(*[F.lit(change[c]).cast(t).alias(c) if c in change else F.col(c)
                                     for c, t in TABLES["lab_results"].columns.items()])
    with pytest.raises(ConstraintError, match=said):
        store.append("lab_results", row, "broken")
    assert store.load("lab_results").count() == 4 and len(store.commits("lab_results")) == 1


def test_repeated_keys_in_one_append(spark, store):
    with pytest.raises(ConstraintError, match="1 values of lab_id are repeated"):
        store.append("lab_results", lab(spark, "x").union(lab(spark, "x")), "twice")


def partition_filters(df, table):
    """The partition filters of the scans of a stored table."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", line)[1]
            for line in plan.split("\n") if "FileScan" in line and f"rows/{table}" in line]


def test_date_and_flag_questions_read_their_folders_only(store):
    t = store.tables()
    asked = {
        "lab_results": [labs.recent_trend(t["lab_results"], t["patients"], "HbA1c", "2025-08-01"),
                        labs.abnormal_this_month(t["lab_results"], t["patients"], "2025-01-15")],
        "adverse_events": [safety.recent_high_grade(t["adverse_events"], t["patients"], t["treatments"], "2025-02-01")],
        "encounters": [encounters.frequent_visitors(t["encounters"], t["patients"], "2025-03-31")],
    }
    for table, frames in asked.items():
        for df in frames:
            found = partition_filters(df, table)
            assert found and all("_month" in f and ">= 20" in f and "<= 20" in f for f in found)
    trend, month = asked["lab_results"]
    assert "collected_date_month#" in partition_filters(trend, "lab_results")[0]
    assert ">= 202502" in partition_filters(trend, "lab_results")[0] and "<= 202508" in partition_filters(trend, "lab_results")[0]
    assert "abnormal_flag_slice" in partition_filters(month, "lab_results")[0]
    for f in partition_filters(labs.abnormal_labs(t["lab_results"], t["patients"]), "lab_results"):
        assert "abnormal_flag_slice" in f


def test_pruned_answers_equal_those_over_plain_tables(store, clinic):
    t = store.tables()
    for ask in (lambda s: labs.recent_trend(s["lab_results"], s["patients"], "HbA1c", "2025-07-15"),
                lambda s: labs.recent_trend(s["lab_results"], s["patients"], "HbA1c", "2025-07-14"),
                lambda s: labs.abnormal_this_month(s["lab_results"], s["patients"], "2025-01-31"),
                lambda s: labs.abnormal_labs(s["lab_results"], s["patients"]),
                lambda s: safety.recent_high_grade(s["adverse_events"], s["patients"], s["treatments"], "2025-01-15"),
                lambda s: encounters.frequent_visitors(s["encounters"], s["patients"], "2025-03-08")):
        assert rows_of(ask(t)) == rows_of(ask(clinic))


@pytest.mark.parametrize("since,before", [(None, None), ("2025-01-08", None), (None, "2025-01-08"), ("2025-01-01", "2025-02-01"),
                                          ("2025-02-01", "2025-01-01")])
def test_bounds_drop_no_row(store, clinic, since, before):
    assert rows_of(in_days(store.table("lab_results"), "collected_date", since, before).select("lab_id")) == rows_of(
        in_days(clinic["lab_results"], "collected_date", since, before).select("lab_id"))


def test_a_null_date_is_kept_and_never_in_a_window(spark, tmp_path, clinic):
    store = ClinicStore(spark, str(tmp_path))
    store.append("patients", clinic["patients"], "a")
    store.append("treatments", literal_rows(spark, "treatments", []), "a", enforce=())
    event = literal_rows(spark, "treatment_outcomes", [dict(
        outcome_id="o", treatment_id="t", patient_id="p1", outcome_type="stable", assessment_date=ts("2025-01-01T00:00").date())])
    assert store.append("treatment_outcomes", event, "a", enforce=("patient_id",)) == 1
    assert store.load("treatment_outcomes", since="2025-01-01", until="2025-01-01").count() == 1
    assert store.load("treatment_outcomes", since="2025-01-02").count() == 0


def test_keys_are_moved_once(store, spark):
    written = lab(spark, "x1", patient_id="nobody").union(lab(spark, "x2", patient_id="nobody")).union(lab(spark, "x2"))
    found = store._violations("lab_results", written, ["patient_id"])
    counts = {r.what: r.n for r in found.collect()}
    assert counts["rows"] == 3 and counts["values of lab_id are repeated"] == 1
    assert counts["rows with a lab_id that is taken"] == 0
    assert counts["rows with a patient_id that is not in patients"] == 2
    plan = re.sub(r"#\d+L?", "", found._jdf.queryExecution().executedPlan().toString()).split("== Initial Plan ==")[-1]
    assert plan.count("hashpartitioning(lab_id") == 1
