"""Patient 360: everything known about a patient in a few rows, for all patients in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carestrata.functions.series import SLICE_ROWS, hot_groups, id_digest, id_slice, ranked
from carestrata.operators.demographics import demographics
from carestrata.operators.encounters import encounter_history
from carestrata.operators.safety import ae_history
from carestrata.operators.treatments import treatment_history
from carestrata.plans.session import release_shuffles

# tab: (date that orders it, unique key, fields shown)
TABS = {
    "encounters": ("admission_date", "encounter_id", [
        "encounter_id", "encounter_type", "admission_date", "discharge_date", "disposition",
        "provider", "specialty"]),
    "diagnoses": ("diagnosed_date", "diagnosis_id", [
        "icd10_code", "description", "status", "diagnosed_date", "resolved_date"]),
    "treatments": ("start_date", "treatment_key", [
        "treatment_name", "treatment_type", "status", "start_date", "end_date", "dosage",
        "frequency", "outcome_type", "outcome_measure", "baseline_value", "result_value", "unit"]),
    "medications": ("prescribed_date", "medication_id", [
        "drug_name", "generic_name", "ndc_code", "dosage_form", "strength", "quantity",
        "refills_remaining", "prescribed_date"]),
    "lab_results": ("collected_date", "lab_id", [
        "test_name", "loinc_code", "result_value", "unit", "reference_low", "reference_high",
        "abnormal_flag", "collected_date"]),
    "adverse_events": ("onset_date", "event_id", [
        "event_type", "severity", "ctcae_grade", "onset_date", "resolution_date", "action_taken",
        "outcome", "treatment_name"]),
}


# fields of the treatments tab that come from an outcome, behind those of the treatment
SEEN = ["outcome_type", "outcome_measure", "baseline_value", "result_value", "unit"]


def _frames(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows of the tabs that need nothing of a treatment."""
    return {
        "encounters": encounter_history(tables["encounters"], tables["providers"]),
        "diagnoses": tables["diagnoses"],
        "medications": tables["medications"],
        "lab_results": tables["lab_results"],
    }


def _united(rows: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def _entries(tables: dict[str, DataFrame]) -> DataFrame:
    """All tabs' rows in one frame: patient, tab, date, key, and the tab's own struct column."""
    treated = treatment_history(tables["treatments"], tables["treatment_outcomes"])
    frames = _frames(tables) | {
        "treatments": treated.withColumn("treatment_key", F.concat_ws(
            "/", F.col("treatment_id").cast("string"), F.col("outcome_id").cast("string"))),
        "adverse_events": ae_history(tables["adverse_events"], tables["treatments"]),
    }
    return _united([
        frames[tab].select(
            "patient_id", F.lit(tab).alias("tab"), F.to_date(day).alias("day"),
            F.col(key).cast("string").alias("key"), F.struct(*fields).alias(tab))
        for tab, (day, key, fields) in TABS.items()
    ])


def _treated(tables: dict[str, DataFrame]) -> DataFrame:
    """Treatments, each with all its outcomes (seen), and adverse events with the name of their treatment: patient, key
    and the tab's struct. Treatments move once for both."""
    own = [f for f in TABS["treatments"][2] if f not in SEEN]
    ae = TABS["adverse_events"][2]
    seen = tables["treatment_outcomes"].groupBy("treatment_id").agg(
        F.collect_list(F.struct("outcome_id", *SEEN)).alias("seen"))
    events = tables["adverse_events"].groupBy("treatment_id").agg(F.collect_list(F.struct(
        "patient_id", *dict.fromkeys(["event_id", *[f for f in ae if f != "treatment_name"]]))).alias("events"))
    treated = (tables["treatments"].join(seen, "treatment_id", "left").join(events, "treatment_id", "left")
               .withColumn("treated", F.struct(*own)))
    kind = {c: treated.schema[c].dataType for c in ("treated", "seen")}
    first = F.struct("patient_id", F.col("treatment_id").cast("string").alias("key"),
                     F.col("treated").alias("treatments"), "seen")
    others = F.transform("events", lambda e: F.struct(
        e["patient_id"].alias("patient_id"), e["event_id"].cast("string").alias("key"),
        F.lit(None).cast(kind["treated"]).alias("treatments"), F.lit(None).cast(kind["seen"]).alias("seen"),
        F.struct(*[F.col("treatment_name") if f == "treatment_name" else e[f].alias(f) for f in ae]).alias("adverse_events")))
    nothing = F.lit(None).cast(treated.select(F.element_at(others, 1)["adverse_events"].alias("e")).schema["e"].dataType)
    first = first.withField("adverse_events", nothing)
    rows = F.when(F.col("events").isNull(), F.array(first)).otherwise(F.concat(F.array(first), others))
    return treated.select(F.explode(rows).alias("row")).select("row.*")


def _gathered(tables: dict[str, DataFrame], person: DataFrame) -> DataFrame:
    """The same rows and ``person`` at their patients, moved there once; tab and date are told from the struct there, and
    the outcomes of a treatment become rows."""
    own = [f for f in TABS["treatments"][2] if f not in SEEN]
    rows = [frame.select("patient_id", F.col(TABS[tab][1]).cast("string").alias("key"), F.struct(*TABS[tab][2]).alias(tab))
            for tab, frame in _frames(tables).items()]
    whole = _united([person, _treated(tables), *rows]).repartition("patient_id")
    whole = whole.select("*", F.explode_outer("seen").alias("outcome"))
    treatment = F.struct(*[F.col(f"treatments.{f}") for f in own], *[F.col(f"outcome.{f}") for f in SEEN])
    here = [(tab, F.col(tab).isNotNull()) for tab in TABS]
    return whole.select(
        "patient_id", "demographics", *[tab for tab in TABS if tab != "treatments"],
        F.when(F.col("treatments").isNotNull(), treatment).alias("treatments"),
        F.coalesce(*[F.when(there, F.lit(tab)) for tab, there in here]).alias("tab"),
        F.coalesce(*[F.when(there, F.to_date(F.col(f"{tab}.{TABS[tab][0]}"))) for tab, there in here]).alias("day"),
        F.when(F.col("treatments").isNotNull(), F.concat_ws("/", "key", F.col("outcome.outcome_id").cast("string")))
        .otherwise(F.col("key")).alias("key"))


def _members(tables: dict[str, DataFrame]) -> DataFrame:
    """Patient and tab of the underlying rows: enough to tell whose tabs are very long."""
    sources = {tab: tab for tab in TABS} | {"treatment_outcomes": "treatments"}
    return reduce(DataFrame.unionByName, [
        tables[name].select("patient_id", F.lit(tab).alias("tab")) for name, tab in sources.items()])


def patient_profiles(tables: dict[str, DataFrame], as_of, page_size: int = 500,
                     slice_rows: int = SLICE_ROWS) -> DataFrame:
    """patient_id, page, demographics, and one array of structs per tab, newest first.

    A tab with more than ``page_size`` entries continues on the next page, so no row grows without
    bound and nothing is left out. Page 0 exists for every patient and carries the demographics. Whether any tab is
    above ``slice_rows`` is counted when this is called.
    """
    group, order = ["patient_id", "tab"], [F.desc_nulls_last("day"), id_digest("key"), F.asc("key")]
    members = _members(tables)
    person = demographics(tables["patients"], as_of)
    person = person.select("patient_id", F.struct(
        *[c for c in person.columns if c != "patient_id"]).alias("demographics"))
    page = F.floor(F.col("position") / page_size).cast("int")
    hot = bool(hot_groups(members, group, slice_rows).take(1))
    release_shuffles(tables["patients"].sparkSession)
    if hot:
        # newest day first; a patient with very many entries is numbered by day and slice of the keys
        undated = F.lit(1 << 31)
        newest_first = F.coalesce(-F.unix_date("day").cast("bigint"), undated) * 65_536 + F.coalesce(id_slice("key"), F.lit(-1))
        entries = ranked(_entries(tables), group, order, newest_first, slice_rows=slice_rows, sized_by=members)
        everything = person.withColumn("page", F.lit(0)).unionByName(
            entries.withColumn("page", page), allowMissingColumns=True)
    else:
        # no tab needs cutting: rows move once, to their patient, and are numbered and gathered there
        whole = _gathered(tables, person)
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
        everything = whole.withColumn("position", place).withColumn(
            "page", F.when(F.col("tab").isNotNull(), page).otherwise(F.lit(0)))

    def array_of(tab: str):
        numbered = F.collect_list(F.when(F.col(tab).isNotNull(), F.struct("position", tab)))
        return F.transform(F.sort_array(numbered), lambda e: e[tab]).alias(tab)

    return everything.groupBy("patient_id", "page").agg(
        F.first("demographics", ignorenulls=True).alias("demographics"), *map(array_of, TABS))


def profile_sizes(profiles: DataFrame) -> DataFrame:
    """Entries per tab on every page."""
    return profiles.select("patient_id", "page", F.col("demographics.mrn").alias("mrn"),
                           F.col("demographics.age").alias("age"),
                           *[F.size(tab).cast("bigint").alias(tab) for tab in TABS])


def profile_tab(profiles: DataFrame, tab: str) -> DataFrame:
    """One tab's entries with all their fields: patient_id, page, at (place on the page) and the fields."""
    return (profiles.select("patient_id", "page", F.posexplode(tab).alias("at", "entry"))
            .select("patient_id", "page", "at", "entry.*"))
