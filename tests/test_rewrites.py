"""Rewritten scorecards equal their definitions."""

import pytest

from carestrata.operators import providers, treatments
from carestrata.sources.retail_mapping import clinical_views
from tests import naive
from tests.comparing import rows_of


@pytest.fixture(scope="module")
def views(spark):
    return clinical_views(spark, "/root/testdata/sf0.001")


def _args(t, names):
    return [t[n] for n in names]


CASES = {
    "efficacy_scorecard": (treatments, ("treatments", "treatment_outcomes", "adverse_events")),
    "treatment_detail": (treatments, ("treatments", "treatment_outcomes", "adverse_events")),
    "cancer_treatment_outcomes": (treatments, ("diagnoses", "treatments", "treatment_outcomes")),
    "provider_activity": (providers, ("providers", "encounters", "treatments")),
}


@pytest.mark.parametrize("name", CASES)
def test_mapped_tables(views, name):
    module, tables = CASES[name]
    args = _args(views, tables)
    assert rows_of(getattr(module, name)(*args)) == rows_of(getattr(naive, name)(*args))


@pytest.mark.parametrize("name", CASES)
def test_small_clinic(clinic, name):
    module, tables = CASES[name]
    args = _args(clinic, tables)
    assert rows_of(getattr(module, name)(*args)) == rows_of(getattr(naive, name)(*args))
