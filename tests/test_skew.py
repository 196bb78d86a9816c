"""The same answers when one patient, one encounter and one provider own a third of all rows."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from carestrata.functions.series import hot_groups
from carestrata.operators import graph, labs, profile
from carestrata.plans.catalog import CATALOG, runners
from carestrata.plans.oracle import oracle_queries
from carestrata.sources.retail_mapping import AS_OF, clinical_views
from tests.comparing import assert_same, database

SMALL = "/root/testdata/sf0.001"
HOT = {
    "orders": {"o_custkey": (7, "o_orderkey % 3 = 0")},
    "events": {"user_id": (7, "event_id % 3 = 0"), "ts": ("2024-01-15 10:00:00", "event_id % 6 = 0")},
    "lineitem": {"l_suppkey": (3, "l_orderkey % 3 = 0")},
}
AFFECTED = [
    "lab_trends", "lab_series", "lab_kpis", "graph_layout", "graph_edges", "graph_summary",
    "patient_profile_sizes", "patient_profile_labs", "readmission_rates", "comorbid_overlaps",
    "mean_time_to_treatment", "efficacy_scorecard", "treatment_detail", "provider_activity",
    "cancer_treatment_outcomes", "diagnosis_cohorts_unique", "ae_monitor", "dose_reduction_outcomes",
    "events_of_patients_on", "service_line_efficacy", "frequent_visitors", "hba1c_trend",
    "treatment_history", "event_rate_trend", "ingest_patients", "ingest_labs", "zip_ranking",
]


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    for file in os.listdir(SMALL):
        name = file.removesuffix(".parquet")
        if name not in HOT:
            shutil.copy(f"{SMALL}/{file}", f"{folder}/{file}")
            continue
        df = spark.read.parquet(f"{SMALL}/{file}")
        for column, (value, where) in HOT[name].items():
            kind = df.schema[column].dataType
            df = df.withColumn(column, F.when(F.expr(where), F.lit(value).cast(kind)).otherwise(F.col(column)))
        df.toPandas().to_parquet(f"{folder}/{file}", index=False, coerce_timestamps="us")
    return folder


@pytest.fixture(scope="module")
def db(skewed):
    return database(skewed)


@pytest.mark.parametrize("name", AFFECTED)
def test_hot_keys_change_nothing(spark, skewed, db, name):
    assert_same(runners()[name](spark, skewed), db, oracle_queries()[name])


@pytest.fixture(scope="module")
def views(spark, skewed):
    return clinical_views(spark, skewed)


def test_hot_series_by_the_hour(views, db):
    assert hot_groups(views["lab_results"], ["patient_id", "test_name"], 40).count() > 0
    assert_same(labs.lab_trends(views["lab_results"], slice_rows=40), db, oracle_queries()["lab_trends"])


@pytest.mark.parametrize("slice_rows", [1, 50])
def test_positions_are_those_of_the_twin_at_every_slicing(spark, skewed, views, db, slice_rows):
    assert_same(graph.graph_layout(graph.graph_nodes(views), slice_rows=slice_rows), db, oracle_queries()["graph_layout"])
    pages = profile.patient_profiles(views, AS_OF, page_size=50, slice_rows=slice_rows)
    labs_of = (pages.select("patient_id", "page", F.posexplode("lab_results").alias("at", "lab"))
               .select("patient_id", "page", "at", "lab.test_name", "lab.result_value", "lab.collected_date"))
    assert_same(labs_of, db, oracle_queries()["patient_profile_labs"])


def test_hot_patient_spans_pages(spark, skewed):
    sizes = runners()["patient_profile_sizes"](spark, skewed)
    assert sizes.filter("patient_id = 7").agg(F.max("page")).first()[0] > 5
    biggest = sizes.agg(*[F.max(c) for c in ("encounters", "lab_results", "treatments")]).first()
    assert max(biggest) <= 50


def test_affected_queries_exist():
    assert set(AFFECTED) <= set(CATALOG)
