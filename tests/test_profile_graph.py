import math

import pytest
from pyspark.sql import functions as F

from carestrata.operators import graph, profile
from carestrata.operators.demographics import demographics
from carestrata.operators.encounters import encounter_history
from carestrata.operators.safety import ae_history
from carestrata.operators.treatments import treatment_history
from carestrata.sources.retail_mapping import AS_OF, clinical_views
from tests.comparing import rows_of


@pytest.fixture(scope="module")
def views(spark):
    return clinical_views(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def paged(spark, views, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("profiles") / "p")
    profile.patient_profiles(views, AS_OF, page_size=20).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("tab", profile.TABS)
def test_profile_holds_every_entry(views, paged, tab):
    flat = {
        "encounters": lambda: encounter_history(views["encounters"], views["providers"]),
        "treatments": lambda: treatment_history(views["treatments"], views["treatment_outcomes"]),
        "adverse_events": lambda: ae_history(views["adverse_events"], views["treatments"]),
    }.get(tab, lambda: views[tab])()
    fields = profile.TABS[tab][2]
    from_profile = paged.select("patient_id", F.explode(tab).alias("e")).select("patient_id", "e.*")
    assert rows_of(from_profile) == rows_of(flat.select("patient_id", *fields))


def test_profile_pages(views, paged):
    assert paged.filter("page = 0").count() == views["patients"].count()
    assert paged.filter("page > 0 and demographics is not null").count() == 0
    assert rows_of(paged.filter("page = 0").select("patient_id", "demographics.*")) == rows_of(
        demographics(views["patients"], AS_OF))
    for tab, (day, _, _) in profile.TABS.items():
        assert paged.agg(F.max(F.size(tab))).first()[0] <= 20
        newest_first = paged.filter(F.size(tab) > 1).select(
            F.forall(F.sequence(F.lit(1), F.size(tab) - 1),
                     lambda i: F.to_date(F.get(F.col(tab), i - 1)[day]) >= F.to_date(F.get(F.col(tab), i)[day]))
            .alias("ok"))
        assert newest_first.filter(~F.col("ok")).count() == 0


def test_patient_without_anything(clinic):
    rows = {r.patient_id: r for r in profile.patient_profiles(clinic, "2025-08-01").collect()}
    assert rows["p4"].demographics.mrn == "M-4" and rows["p4"].lab_results == []
    assert [e.encounter_id for e in rows["p1"].encounters] == ["e3", "e2", "e1"]


def test_treatments_move_once_for_outcomes_and_events(clinic):
    """One read of the treatments for their entries, and the rows are those of the joins: with repeated and null
    treatment ids, outcomes and events that name another patient, and children without a treatment."""
    tables = dict(clinic)
    strange = {"treatments": {"treatment_id": None}, "treatment_outcomes": {"patient_id": "p4"},
               "adverse_events": {"patient_id": None}}
    for name, change in strange.items():
        table = clinic[name]
        odd = table.select(*[F.lit(change[c]).cast(f.dataType).alias(c) if c in change else F.col(c)
                             for c, f in zip(table.columns, table.schema)])
        lost = table.withColumn("treatment_id", F.lit("nowhere"))
        tables[name] = table.union(odd).union(table) if name == "treatments" else table.union(odd).union(lost)
    moved = profile.patient_profiles(tables, "2025-08-01")
    cut = profile.patient_profiles(tables, "2025-08-01", slice_rows=1)
    for tab in profile.TABS:
        assert rows_of(profile.profile_tab(moved, tab).drop("at")) == rows_of(profile.profile_tab(cut, tab).drop("at"))
    assert rows_of(moved.select("patient_id", "page", "demographics")) == rows_of(cut.select("patient_id", "page", "demographics"))
    leaves = profile.patient_profiles(clinic, "2025-08-01")._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("\n").splitlines()
    assert len([leaf for leaf in leaves if "dosage#" in leaf or "treatment_name#" in leaf]) == 1


def test_labels(clinic):
    labels = {r.node_id: r.label for r in graph.graph_nodes(clinic).collect()}
    assert labels["patient:p1"] == "Patient: Ida Holm"
    assert labels["encounter:e1"] == "Enc: inpatient\n2025-01-01 08:00:00+00"
    assert labels["outcome:o1"] == "Out: improvement\nRECIST 1.1 (target lesion"
    assert labels["outcome:o2"] == "Out: stable\n"
    assert labels["adverse_event:a4"] == "AE: Fever\n(life-threatening)"


def test_foreign_treatment_gives_no_edge(clinic):
    other = dict(clinic)
    other["treatment_outcomes"] = clinic["treatment_outcomes"].withColumn(
        "patient_id", F.when(F.col("outcome_id") == "o3", "p2").otherwise(F.col("patient_id")))
    into = {r.dst for r in graph.graph_edges(other).filter("kind = 'treatment-outcome'").collect()}
    assert into == {"outcome:o1", "outcome:o2"}
    assert "outcome:o3" in {r.node_id for r in graph.graph_nodes(other).collect()}


def test_summary(clinic):
    rows = {r.patient_id: r for r in graph.graph_summary(clinic).collect()}
    assert (rows["p1"].encounters, rows["p1"].treatment_outcomes, rows["p1"].has_data) == (3, 3, True)
    assert rows["p4"].has_data is False


def test_layout(clinic):
    rows = graph.graph_layout(graph.graph_nodes(clinic)).collect()
    mine = sorted((r for r in rows if r.patient_id == "p1"), key=lambda r: r.i)
    assert [r.i for r in mine] == list(range(len(mine))) and mine[0].node_id == "patient:p1"
    assert (mine[0].x, mine[0].y) == (0.0, 0.0)
    for r in mine[1:]:
        angle, radius = 2 * math.pi * (r.i - 1) / (r.n - 1), 2 + (r.i % 3) * 0.5
        assert math.isclose(r.x, radius * math.cos(angle), abs_tol=1e-6)
        assert math.isclose(r.y, radius * math.sin(angle), abs_tol=1e-6)
    alone = [r for r in rows if r.patient_id == "p4"]
    assert [(r.i, r.n, r.x, r.y) for r in alone] == [(0, 1, 0.0, 0.0)]


def test_collapsed(clinic):
    rows = {r.label: r.copies for r in graph.collapsed_nodes(graph.graph_nodes(clinic))
            .filter("patient_id = 'p1'").collect()}
    assert rows["Tx: Drug A"] == 2 and rows["AE: Rash\n(mild)"] == 3


def test_paths_follow_edges(views):
    edges = graph.graph_edges(views)
    down = edges.select(F.col("src").alias("patient_node"), F.col("dst").alias("treatment_node"))
    leaf = edges.select(F.col("src").alias("treatment_node"), F.col("dst").alias("leaf_node"))
    two_hops = down.join(leaf, "treatment_node").select("patient_node", "treatment_node", "leaf_node")
    assert rows_of(graph.graph_paths(views).select(*two_hops.columns)) == rows_of(two_hops)
