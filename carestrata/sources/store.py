"""The clinical tables as committed appends: whole or not at all, counted once, laid out for the access paths."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carestrata.functions.bounds import in_days, month_column, month_number, slice_column
from carestrata.functions.predicates import abnormal
from carestrata.schema import TABLES, Table
from carestrata.sources.files import SharedFiles
from carestrata.sources.tables import LAYOUTS

#: Dates by which tables are asked for without a patient; their months are folders.
DATED = {
    "encounters": "admission_date",
    "treatment_outcomes": "assessment_date",
    "adverse_events": "onset_date",
    "lab_results": "collected_date",
}
#: Partial access paths: rows for which the condition holds lie in folders of their own.
SLICES: dict[str, tuple[str, Callable[[], Column]]] = {
    "lab_results": ("abnormal_flag", abnormal),
    "patients": ("is_active", lambda: F.col("is_active")),
}

#: Up to so many new notes are read one by one, more of them by a job.
NOTES_BY_HAND = 50


class ConstraintError(ValueError):
    """An append that breaks a constraint; nothing of it was committed."""


def partition_columns(name: str) -> dict[str, T.DataType]:
    found: dict[str, T.DataType] = {}
    if name in SLICES:
        found[slice_column(SLICES[name][0])] = T.BooleanType()
    if name in DATED:
        found[month_column(DATED[name])] = T.IntegerType()
    return found


def conformed(df: DataFrame, table: Table) -> DataFrame:
    """The table's columns in its declared types (ids as text); columns not given are defaults or NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(c) if c in have else F.lit(table.defaults.get(c))).cast(kind).alias(c) for c, kind in table.columns.items()])


class ClinicStore:
    """Nine tables under one directory.

    ``rows/<table>/append=<name>/`` holds what an append wrote, ``commits/<table>/<append>.json`` makes it part of the
    table. Rows are written first; the commit is one small file that appears whole and only once, so a reader sees
    all of an append or nothing, a crashed attempt leaves rows that no one reads, and repeating a committed append
    changes nothing. The list of appends (names and counts, no rows) is all that reaches the driver.
    """

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory, self.files = spark, directory, SharedFiles(spark)
        self._notes: dict[str, dict[str, dict]] = {}

    def commits(self, name: str) -> list[dict]:
        """The committed appends of a table: append, folder, rows. A note never changes, so each is read once."""
        folder, notes = f"{self.directory}/commits/{name}", self._notes.setdefault(name, {})
        names = [n for n in self.files.names(folder) if not n.startswith(".")]
        new = [n for n in names if n not in notes]
        if len(new) > NOTES_BY_HAND:
            found = self.spark.read.schema("append string, folder string, rows long").json(folder)
            notes.update({f"{row['append']}.json": row.asDict() for row in found.collect()})
        else:
            notes.update({n: json.loads(self.files.read(f"{folder}/{n}")) for n in new})
        return [notes[n] for n in names]

    def table(self, name: str) -> DataFrame:
        """All committed rows, with the partition columns that bound reads (see functions.bounds)."""
        table, parts = TABLES[name], partition_columns(name)
        extra = {"append": T.StringType(), **parts}
        schema = T.StructType([*table.schema.fields, *[T.StructField(c, t) for c, t in extra.items()]])
        root = f"{self.directory}/rows/{name}"
        folders = [f"{root}/{c['folder']}" for c in self.commits(name)]
        if not folders:
            return self.spark.createDataFrame([], schema).drop("append")
        return self.spark.read.schema(schema).option("basePath", root).parquet(*folders).drop("append")

    def load(self, name: str, since=None, until=None) -> DataFrame:
        """All committed rows with the declared columns only; ``since`` and ``until`` (dates, both included) bound
        the table's own date and, where its months are folders, what is read."""
        rows = self.table(name)
        if LAYOUTS[name].year_of:
            before = None if until is None else F.date_add(F.lit(str(until)).cast("date"), 1)
            rows = in_days(rows, LAYOUTS[name].year_of, since, before)
        return rows.select(*TABLES[name].columns)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in TABLES}

    def append(self, name: str, rows: DataFrame, append: str, enforce: Iterable[str] | None = None,
               files: int | None = None) -> int:
        """Add rows under the name of this append and return how many the commit holds.

        Of appends of one name the first to commit counts, and the others return its count. ``enforce`` names the
        references to check against committed parents (all declared ones unless given); a missing required value,
        a key that is repeated or taken, or a reference without its parent raises :class:`ConstraintError`.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", append):
            raise ValueError(f"not a name for an append: {append!r}")
        note = f"{self.directory}/commits/{name}/{append}.json"
        if self.files.exists(note):
            return json.loads(self.files.read(note))["rows"]
        folder = f"append={append}-{uuid.uuid4().hex[:12]}"
        path = f"{self.directory}/rows/{name}/{folder}"
        self._write(name, conformed(rows, TABLES[name]), path, files)
        written = self.spark.read.schema(TABLES[name].schema).parquet(path)
        try:
            count = self._checked(name, written, TABLES[name].references if enforce is None else enforce)
        except ConstraintError:
            self.files.remove(path)
            if self.files.exists(note):  # the same append, committed meanwhile by another
                return json.loads(self.files.read(note))["rows"]
            raise
        if not self.files.put_new(note, json.dumps({"append": append, "folder": folder, "rows": count})):
            self.files.remove(path)
            return json.loads(self.files.read(note))["rows"]
        return count

    def _write(self, name: str, rows: DataFrame, path: str, files: int | None) -> None:
        layout, parts = LAYOUTS[name], list(partition_columns(name))
        if name in SLICES:
            column, holds = SLICES[name]
            rows = rows.withColumn(slice_column(column), F.coalesce(holds(), F.lit(False)))
        if name in DATED:
            rows = rows.withColumn(month_column(DATED[name]), month_number(F.col(DATED[name])))
        # the sort key ends in a unique id, so a patient or month of any size is spread over files
        keys = [*parts, *[k for k in layout.sort if k not in parts]]
        ranged = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
        writer = ranged.sortWithinPartitions(*keys).write.mode("errorifexists")
        (writer.partitionBy(*parts) if parts else writer).parquet(path)

    def _violations(self, name: str, written: DataFrame, enforce: Iterable[str]) -> DataFrame:
        """How many rows there are and how many violations of each constraint: (n, what). Keys are moved once."""
        table = TABLES[name]

        def violations(rows: DataFrame, counted: dict[str, Column]) -> DataFrame:
            """One row per count, all of them from one pass over the rows."""
            names = {f"n{i}": what for i, what in enumerate(counted)}
            return rows.agg(*[n.alias(c) for c, n in zip(names, counted.values())]).select(F.explode(F.array(*[
                F.struct(F.coalesce(F.col(c), F.lit(0)).alias("n"), F.lit(what).alias("what"))
                for c, what in names.items()])).alias("m")).select("m.*")

        found = violations(written, {"rows": F.count(F.lit(1))} | {
            f"rows without {c}": F.count_if(F.col(c).isNull()) for c in [table.key, *table.required]})
        keys = written.select(table.key, F.lit(1).alias("new"), F.lit(0).alias("old"))
        if self.commits(name):
            keys = keys.union(self.table(name).select(table.key, F.lit(0), F.lit(1)))
        keys = keys.groupBy(table.key).agg(F.sum("new").alias("new"), F.sum("old").alias("old"))
        found = found.union(violations(keys, {
            f"values of {table.key} are repeated": F.count_if(F.col("new") > 1),
            f"rows with a {table.key} that is taken": F.sum(F.when((F.col("old") > 0) & F.col(table.key).isNotNull(), F.col("new")))}))
        for column in enforce:
            parent, key = table.references[column]
            # rows are counted per reference before the shuffle: files hold a patient's rows together
            wanted = (written.select(F.col(column).alias(key)).filter(F.col(key).isNotNull())
                      .groupBy(key).agg(F.count(F.lit(1)).alias("n")))
            orphans = wanted.join(self.table(parent).select(key), key, "left_anti")
            found = found.union(violations(orphans, {f"rows with a {column} that is not in {parent}": F.sum("n")}))
        return found

    def _checked(self, name: str, written: DataFrame, enforce: Iterable[str]) -> int:
        """All constraints in one job; gives the number of rows."""
        counts = {row["what"]: row["n"] for row in self._violations(name, written, enforce).filter("n > 0").collect()}
        rows = counts.pop("rows", 0)
        if counts:
            raise ConstraintError(f"{name}: " + "; ".join(f"{n} {what}" for what, n in counts.items()))
        return rows
