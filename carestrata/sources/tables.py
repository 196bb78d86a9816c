"""Read, append and lay out the clinical tables as Parquet."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carestrata.functions.predicates import every
from carestrata.functions.scalars import as_date
from carestrata.schema import TABLES


@dataclass(frozen=True)
class Layout:
    """Where a table's rows go: a coarse date partition, then sort order inside the files."""

    sort: tuple[str, ...]
    year_of: str | None = None


# Every fact is read by patient, most of them by patient and date, some by date alone. Year
# directories serve the date filters; the sort gives row groups narrow patient_id ranges to skip.
LAYOUTS = {
    "patients": Layout(("is_active", "patient_id")),
    "providers": Layout(("provider_id",)),
    "encounters": Layout(("patient_id", "admission_date", "encounter_id"), "admission_date"),
    "diagnoses": Layout(("patient_id", "diagnosed_date", "diagnosis_id"), "diagnosed_date"),
    "treatments": Layout(("patient_id", "start_date", "treatment_id"), "start_date"),
    "medications": Layout(("patient_id", "prescribed_date", "medication_id"), "prescribed_date"),
    "treatment_outcomes": Layout(("patient_id", "assessment_date", "outcome_id"),
                                 "assessment_date"),
    "adverse_events": Layout(("patient_id", "onset_date", "event_id"), "onset_date"),
    "lab_results": Layout(("patient_id", "collected_date", "lab_id"), "collected_date"),
}


def load(spark: SparkSession, directory: str, name: str, since=None, until=None) -> DataFrame:
    """One table with its declared schema; no inference pass over the files.

    ``since`` and ``until`` (dates, both included) bound the table's own date and, through it, the
    year directories that are listed and read.
    """
    table, layout = TABLES[name], LAYOUTS[name]
    if not layout.year_of:
        return spark.read.schema(table.schema).parquet(f"{directory}/{name}")
    schema = T.StructType([*table.schema.fields, T.StructField("year", T.IntegerType())])
    df = spark.read.schema(schema).parquet(f"{directory}/{name}")
    day = F.col(layout.year_of)
    bounds = []
    if since is not None:
        bounds += [F.col("year") >= F.year(as_date(since)), day >= as_date(since)]
    if until is not None:
        bounds += [F.col("year") <= F.year(as_date(until)), day < F.date_add(as_date(until), 1)]
    return df.filter(every(*bounds)).select(*table.columns)


def load_all(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    return {name: load(spark, directory, name) for name in TABLES}


def write_layout(df: DataFrame, directory: str, name: str, mode: str = "errorifexists",
                 files: int | None = None, seen: Observation | None = None) -> None:
    """Write a table in the order its readers want.

    Rows are range-partitioned on the whole sort key, which ends in a unique id, so a patient
    with very many rows is spread over several files instead of ending up in one task.
    """
    layout = LAYOUTS[name]
    keys = list(layout.sort)
    if layout.year_of:
        df = df.withColumn("year", F.year(layout.year_of))
        keys = ["year", *keys]
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    rows = ranged.sortWithinPartitions(*keys)
    if seen is not None:
        # observed after the range shuffle: its sampling pass reads what comes before twice
        rows = rows.observe(seen, F.count("*").alias("rows"))
    writer = rows.write.mode(mode)
    if layout.year_of:
        writer = writer.partitionBy("year")
    writer.parquet(f"{directory}/{name}")


def append_records(df: DataFrame, directory: str, name: str) -> int:
    """Append to a table and return how many rows were written, counted during the write."""
    seen = Observation(f"append_{name}")
    write_layout(df, directory, name, mode="append", seen=seen)
    return seen.get["rows"]


def literal_rows(spark: SparkSession, name: str, rows: Iterable[dict]) -> DataFrame:
    """Rows written out by hand; columns not given are filled with the table's defaults or NULL."""
    table = TABLES[name]
    data = [tuple(row.get(c, table.defaults.get(c)) for c in table.columns) for row in rows]
    return spark.createDataFrame(data, table.schema)


#: Columns that hold ids: keys and references of all tables.
ID_COLUMNS = frozenset(c for t in TABLES.values() for c in (t.key, *t.references))


def to_frame(df: DataFrame) -> DataFrame:
    """Ids as text, everything else as it is: the shape that goes to a tabular client."""
    return df.select(*[
        F.col(c).cast("string").alias(c) if c in ID_COLUMNS or c.endswith("_id") else F.col(c) for c in df.columns
    ])
