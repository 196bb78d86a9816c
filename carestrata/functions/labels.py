"""Codes to display labels and display order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from carestrata.schema import FLAG_LABELS, SERIOUS_SEVERITIES, SEVERITIES

Bands = Sequence[tuple[int | None, str]]


def band_ordinal(value: Column, bands: Bands) -> Column:
    """Position of the band holding ``value``; reports sort by this, not by the label text."""
    expr = F
    for i, (upper, _) in enumerate(bands[:-1]):
        expr = expr.when(value < upper, i)
    return expr.otherwise(len(bands) - 1)


def band_label(ordinal: Column, bands: Bands) -> Column:
    return F.element_at(F.array(*[F.lit(label) for _, label in bands]), ordinal + 1)


def lookup(code: Column, labels: Mapping[str, str]) -> Column:
    """Label for a code; a code without one is shown as it is."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[code], code)


def flag_label(flag: Column) -> Column:
    return lookup(flag, FLAG_LABELS)


def severity_rank(severity: Column) -> Column:
    """1 = mild … 4 = life-threatening, NULL for anything else."""
    return F.nullif(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity), F.lit(0))


def is_serious(by: str = "severity", severity: str = "severity", grade: str = "ctcae_grade") -> Column:
    """Two definitions are in use: the severity word, or CTCAE grade 3 and up."""
    if by == "severity":
        return F.col(severity).isin(SERIOUS_SEVERITIES)
    if by == "grade":
        return F.col(grade) >= 3
    raise ValueError(f"by must be 'severity' or 'grade', not {by!r}")


def service_line(specialty: Column) -> Column:
    """Oncology, cardiology or endocrinology, NULL for every other specialty."""
    expr = F
    for line in ("oncology", "cardiology", "endocrinology"):
        expr = expr.when(F.lower(specialty).contains(line), line)
    return expr
