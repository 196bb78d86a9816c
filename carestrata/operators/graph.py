"""The patient journey graph as node and edge tables, for the whole population at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carestrata.functions.scalars import clipped, utc_text
from carestrata.functions.series import SLICE_ROWS, id_digest, id_slice, ranked
from carestrata.operators.common import person_name
from carestrata.schema import NODE_STYLE

# kind: (table, key)
KINDS = {
    "patient": ("patients", "patient_id"),
    "encounter": ("encounters", "encounter_id"),
    "diagnosis": ("diagnoses", "diagnosis_id"),
    "treatment": ("treatments", "treatment_id"),
    "outcome": ("treatment_outcomes", "outcome_id"),
    "adverse_event": ("adverse_events", "event_id"),
}
_CLINICAL = [k for k in KINDS if k != "patient"]


def node_id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _two_lines(prefix: str, first: str, second: Column) -> Column:
    return F.concat(F.lit(f"{prefix}: "), F.col(first), F.lit("\n"), second)


def _labels() -> dict[str, Column]:
    return {
        "patient": F.concat(F.lit("Patient: "), person_name()),
        "encounter": _two_lines("Enc", "encounter_type", utc_text(F.col("admission_date"))),
        "diagnosis": _two_lines("Dx", "icd10_code", clipped("description", 30)),
        "treatment": F.concat(F.lit("Tx: "), F.col("treatment_name")),
        "outcome": _two_lines("Out", "outcome_type",
                              clipped(F.coalesce("outcome_measure", F.lit("")), 25)),
        "adverse_event": _two_lines("AE", "event_type",
                                    F.concat(F.lit("("), F.col("severity"), F.lit(")"))),
    }


def graph_nodes(tables: dict[str, DataFrame]) -> DataFrame:
    """node_id, kind, label, patient_id, color, size."""
    labels = _labels()
    frames = []
    for kind, (table, key) in KINDS.items():
        size, color = NODE_STYLE[kind]
        frames.append(tables[table].select(
            node_id(kind, key).alias("node_id"), F.lit(kind).alias("kind"),
            labels[kind].alias("label"), "patient_id", F.lit(color).alias("color"),
            F.lit(size).alias("size")))
    return reduce(DataFrame.unionByName, frames)


def _owned_children(tables: dict[str, DataFrame], kind: str) -> DataFrame:
    """Outcomes or events whose treatment is one of the same patient's treatments."""
    table, key = KINDS[kind]
    return (tables[table].select(key, "treatment_id", "patient_id")
            .join(tables["treatments"].select("treatment_id", "patient_id"),
                  ["treatment_id", "patient_id"], "left_semi"))


def graph_edges(tables: dict[str, DataFrame]) -> DataFrame:
    """src, dst, kind, patient_id: patient to what the patient has, treatment to its children."""
    own = [tables[KINDS[k][0]].select(
        node_id("patient", "patient_id").alias("src"), node_id(k, KINDS[k][1]).alias("dst"),
        F.lit(f"patient-{k}").alias("kind"), "patient_id")
        for k in ("encounter", "diagnosis", "treatment")]
    below = [_owned_children(tables, k).select(
        node_id("treatment", "treatment_id").alias("src"), node_id(k, KINDS[k][1]).alias("dst"),
        F.lit(f"treatment-{k}").alias("kind"), "patient_id")
        for k in ("outcome", "adverse_event")]
    return reduce(DataFrame.unionByName, own + below)


def graph_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Counts of the five clinical kinds per patient; has_data is false for a lone patient node."""
    members = reduce(DataFrame.unionByName, [
        tables[table].select("patient_id", F.lit(kind).alias("kind"))
        for kind, (table, _) in KINDS.items()])
    counts = members.groupBy("patient_id").agg(
        *[F.count_if(F.col("kind") == k).alias(KINDS[k][0]) for k in _CLINICAL],
        (F.count_if(F.col("kind") != "patient") > 0).alias("has_data"))
    return counts


def graph_layout(nodes: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Circular layout per patient: the patient in the middle, the others around in kind order.

    Node i of n sits at angle 2π(i−1)/(n−1) and radius 2 + (i mod 3)/2. Nodes of a kind follow a
    digest of their id; a patient with very many nodes is numbered by slices of it, rather than in one task.
    """
    ordinal = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    numbered = nodes.select("node_id", "patient_id", ordinal.alias("ordinal"))
    placed = ranked(numbered, ["patient_id"], [F.asc("ordinal"), id_digest("node_id"), F.asc("node_id")],
                    F.col("ordinal") * 65_536 + id_slice("node_id"), "i", size="n",
                    slice_rows=slice_rows, sized_by=nodes.select("patient_id"))
    angle = 2 * F.pi() * (F.col("i") - 1) / F.nullif(F.col("n") - 1, F.lit(0))
    radius = 2 + (F.col("i") % 3) * 0.5

    def place(value: Column) -> Column:
        return F.when(F.col("i") == 0, 0.0).otherwise(F.round(radius * value, 6) + 0.0)

    return placed.select("patient_id", "node_id", "i", "n", place(F.cos(angle)).alias("x"),
                         place(F.sin(angle)).alias("y"))


def graph_paths(tables: dict[str, DataFrame]) -> DataFrame:
    """patient → treatment → outcome or adverse event, one row per journey.

    A treatment's children already carry the patient, so the second hop needs no join.
    """
    legs = [_owned_children(tables, k).select(
        "patient_id", node_id("patient", "patient_id").alias("patient_node"),
        node_id("treatment", "treatment_id").alias("treatment_node"),
        node_id(k, KINDS[k][1]).alias("leaf_node"), F.lit(k).alias("leaf_kind"))
        for k in ("outcome", "adverse_event")]
    return legs[0].unionByName(legs[1])


def collapsed_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that share a patient and a label drawn as one; ``copies`` says how many they are."""
    return nodes.groupBy("patient_id", "label").agg(
        F.min("kind").alias("kind"), F.min("node_id").alias("node_id"), F.count("*").alias("copies"))
