"""Operators on the hand-counted clinic."""

from pyspark.sql import functions as F

from carestrata.functions.predicates import treatment_facets
from carestrata.operators import (
    demographics, diagnoses, encounters, headline, labs, medications, overlap, pickers, providers, safety,
    treatments,
)
from carestrata.sources.tables import to_frame
from tests.conftest import AS_OF, d


def _rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_age_bands_in_age_order(clinic):
    assert _rows(demographics.age_distribution(clinic["patients"], AS_OF)) == [
        ("< 40", 1), ("40–54", 1), ("65–74", 1)]


def test_insurance_keeps_the_missing_group(clinic):
    assert set(_rows(demographics.insurance_mix(clinic["patients"]))) == {
        ("Medicare", 1), ("Medicaid", 1), (None, 1)}


def test_population_breakdown_tells_subtotal_from_missing(clinic):
    rows = _rows(demographics.population_breakdown(clinic["patients"], AS_OF))
    assert (None, None, 3, 1, 1) in rows
    assert ("65–74", None, 1, 0, 0) in rows and ("65–74", None, 1, 0, 1) in rows


def test_zip_ranking_with_missing_zip(clinic):
    assert _rows(demographics.zip_ranking(clinic["patients"])) == [("10", 2, 1), ("20", 1, 2), (None, 1, 2)]


def test_scorecard(clinic):
    card = treatments.efficacy_scorecard(clinic["treatments"], clinic["treatment_outcomes"],
                                         clinic["adverse_events"])
    assert _rows(card) == [("Drug A", "medication", 1, 2, 1, 0, 66.7, 4, 1),
                           ("Therapy's end", "therapy", 1, 0, 0, 0, None, 0, 0)]
    by_grade = treatments.efficacy_scorecard(clinic["treatments"], clinic["treatment_outcomes"],
                                             clinic["adverse_events"], serious_by="grade")
    assert _rows(by_grade, "serious_ae_count") == [(2,), (0,)]


def test_detail_weighs_outcomes_by_events_unless_corrected(clinic):
    args = clinic["treatments"], clinic["treatment_outcomes"], clinic["adverse_events"]
    # both t1 outcomes three times (three events), the t2 outcome once — but t1 and t2 differ in status
    one_name = args[0].withColumn("status", F.lit("any"))
    plain = treatments.treatment_detail(one_name, *args[1:]).filter("treatment_name = 'Drug A'")
    fixed = treatments.treatment_detail(one_name, *args[1:], corrected=True).filter("treatment_name = 'Drug A'")
    assert _rows(plain, "avg_baseline", "avg_result") == [(33.75, 17.93)]
    assert _rows(fixed, "avg_baseline", "avg_result") == [(22.5, 14.17)]


def test_kpis_without_outcomes_are_zero(clinic):
    kpis = treatments.treatment_kpis(clinic["treatments"], clinic["treatment_outcomes"], treatment_facets("therapy"))
    assert _rows(kpis) == [(1, 1, 0, 0, 0.0)]
    none = treatments.treatment_kpis(clinic["treatments"], clinic["treatment_outcomes"], treatment_facets("surgery"))
    assert _rows(none) == [(0, 0, 0, 0, 0.0)]


def test_baseline_vs_result(clinic):
    df = treatments.baseline_vs_result(clinic["treatments"], clinic["treatment_outcomes"])
    assert _rows(df) == [("Drug A", 22.5, 14.17)]
    assert _rows(treatments.melted(df)) == [("Drug A", "avg_baseline", 22.5), ("Drug A", "avg_result", 14.17)]


def test_outcome_trends_order_and_guard(clinic):
    df = treatments.outcome_trends(clinic["treatment_outcomes"], clinic["patients"], clinic["treatments"])
    assert _rows(df, "outcome_measure", "pct_change") == [
        ("RECIST 1.1", None), ("RECIST 1.1 (target lesion)", -30.0), (None, None)]


def test_recist_response_counts_exactly_thirty_percent(clinic):
    df = treatments.recist_response(clinic["treatments"], clinic["treatment_outcomes"], clinic["diagnoses"],
                                    clinic["encounters"])
    assert _rows(df) == [("Drug A", 1, 1, 1, -30.0, 100.0)]


def test_history_keeps_treatments_without_outcome(clinic):
    df = treatments.treatment_history(clinic["treatments"], clinic["treatment_outcomes"])
    assert _rows(df.filter("patient_id = 'p2'"), "treatment_name", "outcome_id") == [("Therapy's end", None)]
    mine = treatments.treatment_history(clinic["treatments"], clinic["treatment_outcomes"], patient_id="p1")
    assert _rows(mine, "treatment_id", "outcome_id") == [("t2", "o3"), ("t1", "o1"), ("t1", "o2")]


def test_durations_run_to_the_as_of_date(clinic):
    got = {r[0]: r[1:] for r in _rows(treatments.treatment_durations(clinic["treatments"], "2025-01-30"))}
    assert got == {"medication": (2, 10.0, 1, 10.0)}


def test_compare_counts_a_shared_treatment_twice(clinic):
    df = treatments.compare_treatments(clinic["treatments"], clinic["treatment_outcomes"],
                                       clinic["adverse_events"], "drug", "r")
    got = {r[0]: r[1:] for r in _rows(df)}
    assert got["treatments"] == (2.0, 3.0, -1.0) and got["events_per_patient"] == (4.0, 2.0, 2.0)


def test_ae_monitor_duration_of_resolved_only(clinic):
    rows = _rows(safety.ae_monitor(clinic["adverse_events"], clinic["treatments"]))
    assert rows == [("Drug A", "Rash", "mild", None, 1, None), ("Drug A", "Rash", "mild", 3, 2, 1.5),
                    ("Drug A", "Fever", "life-threatening", 2, 1, None)]


def test_severity_orders(clinic):
    assert _rows(safety.ae_by_severity(clinic["adverse_events"])) == [("mild", 3), ("life-threatening", 1)]
    assert _rows(safety.ae_severity_ranked(clinic["adverse_events"])) == [("life-threatening", 1), ("mild", 3)]


def test_dose_reduction_outcomes(clinic):
    df = safety.dose_reduction_outcomes(clinic["adverse_events"], clinic["treatments"], clinic["treatment_outcomes"])
    assert sorted(_rows(df, "outcome_id", "dose_reductions")) == [("o1", 1), ("o2", 1)]


def test_rate_trend_counts_quiet_months(clinic):
    df = safety.event_rate_trend(clinic["treatments"], clinic["adverse_events"], AS_OF)
    got = {r[0]: r[1:3] for r in _rows(df)}
    assert got == {"Drug A": (8, 4), "Therapy's end": (2, 0)}


def test_lab_trend_and_band(clinic):
    points = _rows(labs.lab_trends(clinic["lab_results"]).orderBy("lab_id"), "lab_id", "delta")
    assert [p[0] for p in points] == ["l0", "l1", "l2", "l3"]
    assert [None if p[1] is None else float(p[1]) for p in points] == [None, -1.4, None, None]
    band = labs.lab_series(clinic["lab_results"]).first()
    assert (float(band.band_low), band.band_high, band.points, band.abnormal) == (4.0, None, 4, 2)


def test_top_abnormal_and_flags(clinic):
    assert _rows(labs.top_abnormal_tests(clinic["lab_results"])) == [("HbA1c", 2, 4, 50.0)]
    assert set(_rows(labs.lab_flag_distribution(clinic["lab_results"]))) == {
        ("Critical High", 1), ("High", 1), ("Normal", 1), (None, 1)}


def test_empty_labs(clinic):
    assert _rows(labs.lab_kpis(clinic["lab_results"].limit(0))) == [(0, 0, 0, 0)]


def test_provider_without_visits(clinic):
    df = providers.provider_activity(clinic["providers"], clinic["encounters"], clinic["treatments"])
    assert _rows(df, "provider_name", "encounter_count", "unique_patients", "treatments_ordered") == [
        ("Ann Vik", 2, 1, 2), ("Bo Dahl", 2, 2, 1), ("Cy Moe", 0, 0, 0)]
    load = {r[0]: r[1:] for r in _rows(encounters.specialty_workload(clinic["encounters"], clinic["providers"]))}
    assert load["Cardiology"] == (2, 2, 2, 1.0)


def test_readmissions(clinic):
    got = {r.encounter_id: r.readmitted for r in encounters.readmissions(clinic["encounters"]).collect()}
    # e2 is 30 days after e1's discharge; e2 itself starts on its own discharge day; e3 comes 32 days later
    assert got == {"e1": True, "e2": False, "e3": False}


def test_time_to_treatment(clinic):
    df = diagnoses.time_to_treatment(clinic["diagnoses"], clinic["treatments"], "C")
    assert _rows(df) == [("p1", d("2025-01-02"), d("2025-01-10"), 8)]


def test_cancer_prefix_is_case_sensitive(clinic):
    df = diagnoses.cohort_sizes(clinic["diagnoses"].filter(F.col("icd10_code").startswith("C")))
    assert _rows(df) == [("C34.90", "Lung", 1, 2)]


def test_cohort_counts_diagnoses_and_people(clinic):
    df = diagnoses.diagnosis_cohorts(clinic["diagnoses"], clinic["patients"], AS_OF, unique_patients=True)
    assert ("C34.90", "Lung", "Female", "< 55", 2, 1) in _rows(df)


def test_overlaps_include_the_shared_day(clinic):
    df = overlap.comorbid_overlaps(clinic["treatments"], clinic["diagnoses"], AS_OF)
    assert sorted(_rows(df, "treatment_id", "episode", "overlapping")) == [("t1", 1, 1), ("t2", 1, 1)]


def test_current_medications(clinic):
    df = medications.current_medications(clinic["medications"], clinic["treatments"], clinic["patients"], AS_OF)
    assert sorted(_rows(df, "medication_id")) == [("m1",), ("m3",)]
    mine = medications.current_medications(clinic["medications"], clinic["treatments"], clinic["patients"],
                                           AS_OF, mrn="M-2")
    assert _rows(mine, "medication_id") == [("m3",)]


def test_kpi_cards_order(clinic):
    df = headline.kpi_cards(clinic["patients"], clinic["treatments"], clinic["encounters"],
                            clinic["adverse_events"])
    assert [r.value for r in df.collect()] == ["3", "1", "4", "4", "2"]


def test_pickers(clinic):
    assert _rows(pickers.active_patients(clinic["patients"]), "mrn") == [("M-4",), ("M-1",), ("M-2",)]
    assert _rows(pickers.encounter_choices(clinic["encounters"], clinic["patients"], k=1), "encounter_id", "adm") == [
        ("e4", "2025-07-01 09:00:00+00")]
    assert _rows(pickers.test_choices(clinic["lab_results"], patient_id="p2")) == []


def test_ids_as_text(spark):
    df = spark.createDataFrame([(1, 2)], "patient_id bigint, n int")
    assert to_frame(df).dtypes == [("patient_id", "string"), ("n", "int")]
