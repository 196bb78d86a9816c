"""Every query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from carestrata.plans.catalog import runners
from tests.comparing import assert_same, database

SMALL = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(runners()))
def test_query_equals_its_twin(spark, db, name):
    df = runners()[name](spark, SMALL)
    if name in ORACLE:
        assert_same(df, db, ORACLE[name])
    else:
        assert df.count() > 0


def test_only_the_nested_query_has_no_twin():
    assert set(runners()) - set(ORACLE) == {"patient_profiles"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["treatment_name", "treatment_type", "unique_patients"]
    assert df.count() > 0
