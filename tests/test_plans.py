"""The physical plans: filters and columns reach the scan, nothing is multiplied out, no Python."""

import re

import pytest

from pyspark.sql import functions as F

from carestrata.functions.series import ranked
from carestrata.operators import demographics, diagnoses, encounters, labs, providers, safety, treatments
from carestrata.plans.catalog import CATALOG
from carestrata.plans.session import configure
from carestrata.sources.retail_mapping import clinical_views
from carestrata.sources.tables import load_all, write_layout


@pytest.fixture(scope="module")
def stored(spark, clinic, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("stored"))
    for name, df in clinic.items():
        write_layout(df, where, name)
    return load_all(spark, where)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_no_products_no_python(spark, name):
    plan = _plan(CATALOG[name](clinical_views(spark, "/root/testdata/sf0.001")))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas",
                     "ExistingRDD"):
        assert operator not in plan


def test_filters_reach_the_scan(stored):
    assert "EqualTo(status,active)" in _plan(diagnoses.diagnosis_cohorts(
        stored["diagnoses"], stored["patients"], "2025-08-01"))
    assert "Not(EqualTo(abnormal_flag,N))" in _plan(labs.abnormal_labs(stored["lab_results"], stored["patients"]))
    assert "StringStartsWith(icd10_code,C)" in _plan(treatments.cancer_treatment_outcomes(
        stored["diagnoses"], stored["treatments"], stored["treatment_outcomes"]))
    assert "GreaterThanOrEqual(ctcae_grade,3)" in _plan(safety.recent_high_grade(
        stored["adverse_events"], stored["patients"], stored["treatments"], "2025-08-01"))
    assert "EqualTo(is_active,true)" in _plan(demographics.gender_distribution(stored["patients"]))
    assert "EqualTo(patient_id,p1)" in _plan(encounters.encounter_history(
        stored["encounters"], stored["providers"], patient_id="p1"))
    trend = _plan(labs.recent_trend(stored["lab_results"], stored["patients"], "HbA1c", "2025-08-01"))
    assert "EqualTo(test_name,HbA1c)" in trend and "GreaterThanOrEqual(collected_date,2025-02-01" in trend


def test_only_needed_columns_are_read(stored):
    plan = _plan(treatments.efficacy_scorecard(stored["treatments"], stored["treatment_outcomes"],
                                               stored["adverse_events"]))
    assert "ReadSchema: struct<treatment_id:string,outcome_type:string>" in plan
    assert "ReadSchema: struct<treatment_id:string,severity:string>" in plan
    assert "ReadSchema: struct<treatment_id:string,patient_id:string,treatment_type:string,treatment_name:string>" in plan
    plan = _plan(demographics.gender_distribution(stored["patients"]))
    assert "ReadSchema: struct<gender:string,is_active:boolean>" in plan


def test_top_k_is_chosen_before_joins(stored):
    plan = _plan(labs.abnormal_labs(stored["lab_results"], stored["patients"]))
    join, top = plan.index("BroadcastHashJoin"), plan.rindex("TakeOrderedAndProject")
    assert join < top and "SortMergeJoin" not in plan


def test_scorecard_children_are_summed_before_the_join(stored):
    plan = _plan(providers.provider_activity(stored["providers"], stored["encounters"], stored["treatments"]))
    assert plan.index("Join") < plan.index("partial_count") and "Expand" not in plan
    assert "Expand" not in _plan(treatments.efficacy_scorecard(
        stored["treatments"], stored["treatment_outcomes"], stored["adverse_events"]))


def test_derived_tables_read_the_written_treatments(spark):
    views = clinical_views(spark, "/root/testdata/sf0.001")
    for name in ("treatments", "medications", "treatment_outcomes", "adverse_events"):
        assert "lineitem.parquet" not in _plan(views[name])


def test_profiles_move_their_entries_once(spark):
    plan = re.sub(r"#\d+L?", "", _plan(CATALOG["patient_profiles"](clinical_views(spark, "/root/testdata/sf0.001"))))
    assert plan.count("Exchange hashpartitioning(patient_id") == 1 and "hashpartitioning(patient_id, page" not in plan


def test_ranked_rows_move_once_to_their_cell(spark):
    rows = spark.range(100).selectExpr("id % 3 as g", "id")
    plan = re.sub(r"#\d+L?", "", _plan(ranked(rows, ["g"], [F.asc("id")], F.col("id"), slice_rows=5)))
    assert plan.count("REPARTITION_BY_COL") == 1 and "Exchange hashpartitioning(g, _step" in plan


def test_days_of_treatments_are_never_held_whole(spark):
    plan = re.sub(r"#\d+L?", "", _plan(CATALOG["comorbid_overlaps"](clinical_views(spark, "/root/testdata/sf0.001"))))
    assert "SortMergeJoin [patient_id, until]" in plan and "SortMergeJoin [patient_id, start_date]" in plan


def test_tables_that_tasks_build_are_small(spark):
    configure(spark)
    assert spark.conf.get("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold") == "4MB"
