"""Record entry as batches: check the submitted rows, fill in what follows from them, keep the rest.

A batch row carries a ``submission_id`` unique to it. Each function returns the batch with the
table's columns, a ``reason`` (NULL for an accepted row) and nothing dropped; :func:`accepted` and
:func:`rejected` split it. Ids derive from the submission, so running a batch again gives the same
rows.

Keys are looked up the same way everywhere: the batch's distinct keys pick their rows out of the big
table first, and only those come back to the batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carestrata import schema
from carestrata.functions.scalars import as_date, blank_to_null, stable_uuid
from carestrata.operators.common import ids

Rule = tuple[str, Column]


def _clean(batch: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Blank text becomes NULL; columns the batch lacks are NULL."""
    types = dict(batch.dtypes)
    return batch.select("submission_id", *[
        F.lit(None).cast("string").alias(c) if c not in types
        else blank_to_null(c).alias(c) if types[c] == "string" else F.col(c)
        for c in columns])


def _given(*columns: str) -> list[Rule]:
    return [(f"{c} is required", F.col(c).isNotNull()) for c in columns]


def _one_of(column: str, choices: Sequence[str]) -> Rule:
    return f"{column} not in list", F.col(column).isNull() | F.col(column).isin(list(choices))


def _lengths(table: schema.Table, columns: Sequence[str]) -> list[Rule]:
    return [(f"{c} too long", F.col(c).isNull() | (F.length(c) <= table.max_length[c]))
            for c in columns if c in table.max_length]


def _judged(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """First broken rule as ``reason``."""
    return df.withColumn("reason", F.coalesce(
        *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in rules]))


def _looked_up(batch: DataFrame, parents: DataFrame, key: str, bring: dict[str, str],
               flag: str) -> DataFrame:
    """Batch with ``flag`` (parent exists) and the parent columns in ``bring`` (name → new name)."""
    wanted = ids(batch.filter(F.col(key).isNotNull()), key)
    found = (parents.select(key, *[F.col(c).alias(n) for c, n in bring.items()])
             .join(wanted, key, "left_semi").withColumn(flag, F.lit(True)))
    return batch.join(found, key, "left").na.fill(False, [flag])


def _finished(checked: DataFrame, table: schema.Table, at: Column | None) -> DataFrame:
    """The table's columns with ids and defaults filled in, plus submission_id and reason."""
    now = F.current_timestamp() if at is None else at
    have = set(checked.columns)
    out = []
    for column, kind in table.columns.items():
        if column == table.key:
            value = stable_uuid(F.lit(table.name), F.col("submission_id").cast("string"))
        elif column in ("created_at", "updated_at"):
            value = now
        else:
            value = F.col(column) if column in have else F.lit(None)
            if column in table.defaults:
                value = F.coalesce(value, F.lit(table.defaults[column]))
        out.append(value.cast(kind).alias(column))
    return checked.select("submission_id", *out, "reason")


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNull()).drop("reason", "submission_id")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNotNull())


def ingest_patients(batch: DataFrame, patients: DataFrame, as_of, at: Column | None = None) -> DataFrame:
    """MRN and both names required, born 1920 to ``as_of``, MRN not taken and used once.

    Of several good rows with one MRN, the smallest submission_id wins. The winner is an aggregate
    per MRN, so copies combine before the shuffle.
    """
    columns = ["mrn", "first_name", "last_name", "date_of_birth", "gender", "race", "ethnicity",
               "insurance_type", "zip_code"]
    rules = [
        *_given("mrn", "first_name", "last_name", "date_of_birth"),
        ("date_of_birth out of range",
         F.col("date_of_birth").between(F.lit("1920-01-01").cast("date"), as_date(as_of))),
        *_lengths(schema.PATIENTS, columns),
        _one_of("gender", schema.GENDERS), _one_of("race", schema.RACES),
        _one_of("ethnicity", schema.ETHNICITIES), _one_of("insurance_type", schema.INSURANCE_TYPES),
    ]
    judged = _judged(_clean(batch, columns), rules)
    winners = (judged.filter(F.col("reason").isNull())
               .groupBy("mrn").agg(F.min("submission_id").alias("submission_id"))
               .join(patients.select("mrn"), "mrn", "left_anti")
               .select("submission_id", F.lit(True).alias("first_use")))
    unique = judged.join(winners, "submission_id", "left").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("first_use").isNull(), "mrn already in use")))
    return _finished(unique, schema.PATIENTS, at)


def ingest_encounters(batch: DataFrame, patients: DataFrame, providers: DataFrame,
                      at: Column | None = None) -> DataFrame:
    """Patient and provider have to exist; a blank complaint is NULL."""
    columns = ["patient_id", "provider_id", "encounter_type", "admission_date", "chief_complaint",
               "disposition"]
    df = _clean(batch, columns)
    df = _looked_up(df, patients, "patient_id", {}, "known_patient")
    df = _looked_up(df, providers, "provider_id", {}, "known_provider")
    rules = [
        ("unknown patient", F.col("known_patient")), ("unknown provider", F.col("known_provider")),
        *_given("encounter_type", "admission_date"), *_lengths(schema.ENCOUNTERS, columns),
        _one_of("encounter_type", schema.ENCOUNTER_TYPES), _one_of("disposition", schema.DISPOSITIONS),
    ]
    return _finished(_judged(df, rules), schema.ENCOUNTERS, at)


def ingest_diagnoses(batch: DataFrame, encounters: DataFrame, at: Column | None = None) -> DataFrame:
    """The patient is the encounter's."""
    columns = ["encounter_id", "icd10_code", "description", "diagnosis_type", "diagnosed_date", "status"]
    df = _looked_up(_clean(batch, columns), encounters, "encounter_id",
                    {"patient_id": "patient_id"}, "known_encounter")
    rules = [
        ("unknown encounter", F.col("known_encounter")),
        *_given("icd10_code", "description", "diagnosis_type", "diagnosed_date"),
        *_lengths(schema.DIAGNOSES, columns),
        _one_of("diagnosis_type", schema.DIAGNOSIS_TYPES), _one_of("status", schema.DIAGNOSIS_STATUSES),
    ]
    return _finished(_judged(df, rules), schema.DIAGNOSES, at)


def ingest_treatments(batch: DataFrame, encounters: DataFrame, at: Column | None = None) -> DataFrame:
    """Patient and provider are the encounter's; blank dosage and frequency are NULL."""
    columns = ["encounter_id", "treatment_type", "treatment_name", "start_date", "dosage",
               "frequency", "route", "status"]
    df = _looked_up(_clean(batch, columns), encounters, "encounter_id",
                    {"patient_id": "patient_id", "provider_id": "provider_id"}, "known_encounter")
    rules = [
        ("unknown encounter", F.col("known_encounter")),
        *_given("treatment_name", "treatment_type", "start_date"),
        *_lengths(schema.TREATMENTS, columns),
        _one_of("treatment_type", schema.TREATMENT_TYPES), _one_of("route", schema.ROUTES),
        _one_of("status", schema.TREATMENT_STATUSES),
    ]
    return _finished(_judged(df, rules), schema.TREATMENTS, at)


def ingest_labs(batch: DataFrame, encounters: DataFrame, at: Column | None = None,
                zero_reference_is_missing: bool = False) -> DataFrame:
    """The patient is the encounter's; a collection date becomes its midnight.

    A reference limit of 0 is kept unless ``zero_reference_is_missing``.
    """
    columns = ["encounter_id", "test_name", "loinc_code", "result_value", "unit", "reference_low",
               "reference_high", "abnormal_flag", "collected_date"]
    df = _clean(batch, columns).withColumn("collected_date", F.col("collected_date").cast("timestamp"))
    if zero_reference_is_missing:
        for limit in ("reference_low", "reference_high"):
            df = df.withColumn(limit, F.when(F.col(limit) != 0, F.col(limit)))
    df = _looked_up(df, encounters, "encounter_id", {"patient_id": "patient_id"}, "known_encounter")
    rules = [
        ("unknown encounter", F.col("known_encounter")), *_given("test_name", "collected_date"),
        *_lengths(schema.LAB_RESULTS, columns), _one_of("abnormal_flag", schema.ABNORMAL_FLAGS),
    ]
    return _finished(_judged(df, rules), schema.LAB_RESULTS, at)


def ingest_adverse_events(batch: DataFrame, treatments: DataFrame, at: Column | None = None) -> DataFrame:
    """The patient is the treatment's; a grade is 1 to 5 or missing."""
    columns = ["treatment_id", "event_type", "severity", "ctcae_grade", "onset_date",
               "action_taken", "outcome"]
    df = _looked_up(_clean(batch, columns), treatments, "treatment_id",
                    {"patient_id": "patient_id"}, "known_treatment")
    rules = [
        ("unknown treatment", F.col("known_treatment")),
        *_given("event_type", "severity", "onset_date"),
        ("ctcae_grade out of range", F.col("ctcae_grade").isNull() | F.col("ctcae_grade").between(1, 5)),
        *_lengths(schema.ADVERSE_EVENTS, columns),
        _one_of("severity", schema.SEVERITIES), _one_of("outcome", schema.AE_OUTCOMES),
    ]
    return _finished(_judged(df, rules), schema.ADVERSE_EVENTS, at)


def record(checked: DataFrame, directory: str, batch: int | str) -> None:
    """Write a checked batch once, accepted and rejected rows side by side.

    The batch has its own folder, replaced when the batch is run again: a retry changes nothing.
    """
    status = F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")
    (checked.withColumn("status_of_entry", status).write.mode("overwrite")
     .partitionBy("status_of_entry").parquet(f"{directory}/ingest_batch={batch}"))
