"""Every named query: a function from the nine tables to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carestrata.functions.predicates import ae_facets, lab_facets, treatment_facets
from carestrata.operators import (
    demographics as people,
    diagnoses as dx,
    encounters as enc,
    graph,
    headline,
    ingest,
    labs,
    medications as meds,
    overlap,
    pickers,
    profile,
    providers as staff,
    safety,
    treatments as tx,
)
from carestrata.plans.session import configure, shared_folder
from carestrata.sources.retail_mapping import AS_OF, COLUMNS, LABS_AS_OF, clinical_views
from carestrata.schema import TABLES
from carestrata.sources.store import ClinicStore
from carestrata.sources.tables import to_frame
from carestrata.streaming.entry import recorded, start_entry
from carestrata.streaming.surveillance import current, start_surveillance

Tables = Mapping[str, DataFrame]

P, PR, E, D, T, M, O, A, L = (
    "patients", "providers", "encounters", "diagnoses", "treatments", "medications",
    "treatment_outcomes", "adverse_events", "lab_results",
)
MEDICATION = partial(treatment_facets, "medication", "active")
SEVERE_OPEN = partial(ae_facets, severity="severe", unresolved_only=True)
NAUSEA = partial(ae_facets, event_type="Nausea")
HBA1C, HIGH_HBA1C = partial(lab_facets, "HbA1c"), partial(lab_facets, "HbA1c", "H")


def _op(function: Callable, *names: str, facets: Callable | None = None,
        **options) -> Callable[[Tables], DataFrame]:
    """Call an operator on named tables; facet columns are built once there is a session."""
    return lambda tables: function(*[tables[n] for n in names], **options,
                                   **({"facets": facets()} if facets else {}))


def _whole(function: Callable, **options) -> Callable[[Tables], DataFrame]:
    return lambda tables: function(tables, **options)


DASHBOARD = {
    "age_distribution": _op(people.age_distribution, P, as_of=AS_OF),
    "gender_distribution": _op(people.gender_distribution, P),
    "insurance_mix": _op(people.insurance_mix, P),
    "efficacy_scorecard": _op(tx.efficacy_scorecard, T, O, A),
    "outcome_trends": _op(tx.outcome_trends, O, P, T),
    "ae_monitor": _op(safety.ae_monitor, A, T),
    "ae_by_severity": _op(safety.ae_by_severity, A),
    "provider_activity": _op(staff.provider_activity, PR, E, T),
    "diagnosis_cohorts": _op(dx.diagnosis_cohorts, D, P, as_of=AS_OF),
    "diagnosis_cohorts_unique": _op(dx.diagnosis_cohorts, D, P, as_of=AS_OF, unique_patients=True),
    "abnormal_labs": _op(labs.abnormal_labs, L, P),
    "kpi_cards": _op(headline.kpi_cards, P, T, E, A),
    "cancer_treatment_outcomes": _op(tx.cancer_treatment_outcomes, D, T, O),
}

OVERVIEW = {
    "headline_counts": _op(headline.headline_counts, P, PR, E, T, A),
    "encounters_by_type": _op(enc.encounters_by_type, E),
    "diagnoses_by_status": _op(dx.diagnoses_by_status, D),
    "patients_by_insurance": _op(people.patients_by_insurance, P),
    "treatments_by_type": _op(tx.treatments_by_type, T),
    "recent_encounters": _op(enc.recent_encounters, E, P, PR),
}

PATIENT = {
    "search_patients": _op(people.search_patients, P, term="p0000001_3"),
    "demographics": _op(people.demographics, P, as_of=AS_OF),
    "encounter_history": _op(enc.encounter_history, E, PR),
    "encounter_history_one": _op(enc.encounter_history, E, PR, patient_id=7),
    "diagnosis_history": _op(dx.diagnosis_history, D),
    "treatment_history": _op(tx.treatment_history, T, O),
    "treatment_history_by_name": _op(tx.treatment_history_by_name, T, O, P, name="Ana P000000005"),
    "medication_history": _op(meds.medication_history, M),
    "lab_history": _op(labs.lab_history, L),
    "ae_history": _op(safety.ae_history, A, T),
    "patient_profiles": _whole(profile.patient_profiles, as_of=AS_OF, page_size=50),
    "patient_profile_sizes": lambda t: profile.profile_sizes(
        profile.patient_profiles(t, AS_OF, page_size=50)),
    "patient_profile_labs": lambda t: (
        profile.patient_profiles(t, AS_OF, page_size=50)
        .select("patient_id", "page", F.posexplode("lab_results").alias("at", "lab"))
        .select("patient_id", "page", "at", "lab.test_name", "lab.result_value", "lab.collected_date")),
    "patient_profile_people": lambda t: (
        profile.patient_profiles(t, AS_OF, page_size=50).filter("page = 0").select("patient_id", "demographics.*")),
    **{f"patient_profile_{tab}": (lambda t, tab=tab: profile.profile_tab(
        profile.patient_profiles(t, AS_OF, page_size=50), tab)) for tab in profile.TABS},
}

TREATMENT = {
    "treatment_kpis": _op(tx.treatment_kpis, T, O),
    "treatment_kpis_faceted": _op(tx.treatment_kpis, T, O, facets=MEDICATION),
    "outcome_distribution": _op(tx.outcome_distribution, T, O),
    "outcome_distribution_faceted": _op(tx.outcome_distribution, T, O, facets=MEDICATION),
    "baseline_vs_result": _op(tx.baseline_vs_result, T, O),
    "baseline_vs_result_faceted": _op(tx.baseline_vs_result, T, O, facets=MEDICATION),
    "baseline_vs_result_long": lambda t: tx.melted(tx.baseline_vs_result(t[T], t[O])),
    "treatment_detail": _op(tx.treatment_detail, T, O, A),
    "treatment_detail_faceted": _op(tx.treatment_detail, T, O, A, facets=MEDICATION),
    "treatment_detail_corrected": _op(tx.treatment_detail, T, O, A, corrected=True),
}

SAFETY = {
    "ae_kpis": _op(safety.ae_kpis, A),
    "ae_severity_ranked": _op(safety.ae_severity_ranked, A),
    "ae_severity_ranked_faceted": _op(safety.ae_severity_ranked, A, facets=NAUSEA),
    "ae_top_treatments": _op(safety.ae_top_treatments, A, T),
    "ae_top_treatments_faceted": _op(safety.ae_top_treatments, A, T, facets=SEVERE_OPEN),
    "ae_grade_distribution": _op(safety.ae_grade_distribution, A),
    "ae_grade_distribution_faceted": _op(safety.ae_grade_distribution, A, facets=SEVERE_OPEN),
    "ae_detail": _op(safety.ae_detail, A, P, T),
    "ae_detail_faceted": _op(safety.ae_detail, A, P, T, facets=SEVERE_OPEN),
}

LABS = {
    "lab_kpis": _op(labs.lab_kpis, L),
    "lab_flag_distribution": _op(labs.lab_flag_distribution, L),
    "lab_flag_distribution_faceted": _op(labs.lab_flag_distribution, L, facets=HBA1C),
    "top_abnormal_tests": _op(labs.top_abnormal_tests, L),
    "patients_with_labs": _op(labs.patients_with_labs, P, L, term="EVA"),
    "lab_detail": _op(labs.lab_detail, L, P),
    "lab_detail_faceted": _op(labs.lab_detail, L, P, facets=HIGH_HBA1C),
    "lab_trends": _op(labs.lab_trends, L),
    "lab_series": _op(labs.lab_series, L),
}

PICKERS = {
    "treatment_type_choices": _op(pickers.treatment_type_choices, T),
    "event_type_choices": _op(pickers.event_type_choices, A),
    "test_choices": _op(pickers.test_choices, L),
    "test_choices_one_patient": _op(pickers.test_choices, L, patient_id=7),
    "active_patients": _op(pickers.active_patients, P),
    "active_providers": _op(pickers.active_providers, PR),
    "encounter_choices": _op(pickers.encounter_choices, E, P),
    "active_treatment_choices": _op(pickers.active_treatment_choices, T, P),
    "latest_patients": _op(pickers.latest_patients, P),
    "latest_encounters": _op(pickers.latest_encounters, E, P),
}

GRAPH = {
    "graph_nodes": _whole(graph.graph_nodes),
    "graph_edges": _whole(graph.graph_edges),
    "graph_summary": _whole(graph.graph_summary),
    "graph_layout": lambda t: graph.graph_layout(graph.graph_nodes(t)),
    "graph_paths": _whole(graph.graph_paths),
    "graph_collapsed": lambda t: graph.collapsed_nodes(graph.graph_nodes(t)),
    "graph_patient_choices": _op(people.search_patients, P, term="chi", k=20),
}

QUESTIONS = {
    "current_medications": _op(meds.current_medications, M, T, P, as_of=AS_OF),
    "current_medications_one": _op(meds.current_medications, M, T, P, as_of=AS_OF, mrn="MRN-000010"),
    "breast_cancer_patients": _op(dx.patients_with_condition, D, P, code_prefix="C50"),
    "breast_cancer_under_treatment": _op(dx.under_treatment, D, T, code_prefix="C50"),
    "hba1c_trend": _op(labs.recent_trend, L, P, test_name="HbA1c", as_of=LABS_AS_OF),
    "hba1c_trend_one": _op(labs.recent_trend, L, P, test_name="HbA1c", as_of=LABS_AS_OF,
                           mrn="MRN-000002"),
    "events_of_treatment": _op(safety.events_of_treatment, A, T, name="red anvil"),
    "events_of_patients_on": _op(safety.events_of_patients_on, A, T, name="red anvil"),
    "abnormal_labs_this_month": _op(labs.abnormal_this_month, L, P, as_of=LABS_AS_OF),
    "compare_treatments": _op(tx.compare_treatments, T, O, A, first="anvil", second="bolt"),
    "recist_response": _op(tx.recist_response, T, O, D, E, code_prefix="C"),
    "dose_reduction_outcomes": _op(safety.dose_reduction_outcomes, A, T, O),
    "comorbid_overlaps": _op(overlap.comorbid_overlaps, T, D, as_of=AS_OF),
    "time_to_treatment": _op(dx.time_to_treatment, D, T, code_prefix="C50"),
    "mean_time_to_treatment": _op(dx.mean_time_to_treatment, D, T, code_prefix="C50"),
    "population_breakdown": _op(people.population_breakdown, P, as_of=AS_OF),
    "zip_ranking": _op(people.zip_ranking, P),
    "cancer_gender_distribution": _op(dx.cancer_gender_distribution, D, P),
    "cohort_sizes": _op(dx.cohort_sizes, D),
    "treatment_ranking": _op(tx.treatment_ranking, T, O, A),
    "treatment_ranking_cancer": _op(tx.treatment_ranking, T, O, A, D),
    "serious_rate_above": _op(safety.serious_rate_above, T, A, threshold_pct=2),
    "treatment_durations": _op(tx.treatment_durations, T, as_of=AS_OF),
    "treatment_mix": _op(tx.treatment_mix, T),
    "recent_high_grade": _op(safety.recent_high_grade, A, P, T, as_of=AS_OF, days=365),
    "ae_rate_per_patient": _op(safety.ae_rate_per_patient, T, A),
    "actions_for_severe": _op(safety.actions_for_severe, A),
    "treatment_success": _op(tx.treatment_success, T, O, A),
    "treatment_success_by_grade": _op(tx.treatment_success, T, O, A, serious_by="grade"),
    "actively_treating": _op(staff.actively_treating, T),
    "providers_by_patients": _op(staff.provider_activity, PR, E, T, by="unique_patients"),
    "mean_event_rate": _op(safety.mean_event_rate, T, A),
    "service_line_efficacy": _op(tx.service_line_efficacy, T, O, PR),
    "department_volume": _op(enc.department_volume, E, PR),
    "specialty_workload": _op(enc.specialty_workload, E, PR),
    "event_rate_trend": _op(safety.event_rate_trend, T, A, as_of=AS_OF),
    "frequent_visitors": _op(enc.frequent_visitors, E, P, as_of=AS_OF),
    "readmission_rates": _op(enc.readmission_rates, E, D),
    "older_patients_with_active_cancer": _op(people.older_patients_with_active_cancer, P, D, as_of=AS_OF),
}


# Submitted batches, derived from the tables with faults worked in by rule. The same expressions
# make the batch in the checking database.
SUBMISSIONS = {
    "patients": (P, {
        "submission_id": "lpad(cast(patient_id as string), 9, '0')",
        "mrn": "case when patient_id % 7 = 0 then mrn when patient_id % 3 = 0 then 'NEW-SHARED' when patient_id % 31 = 1 then concat(mrn, '-much-too-long-for-an-mrn') else concat('NEW-', cast(patient_id as string)) end",
        "first_name": "case when patient_id % 13 = 0 then ' ' else first_name end",
        "last_name": "last_name", "date_of_birth": "date_of_birth", "gender": "gender",
        "race": "case when patient_id % 17 = 0 then 'Unknown' else race end",
        "ethnicity": "ethnicity", "insurance_type": "insurance_type",
        "zip_code": "case when patient_id % 5 = 0 then '' else zip_code end",
    }),
    "encounters": (E, {
        "submission_id": "cast(encounter_id as string)",
        "patient_id": "case when encounter_id % 17 = 0 then -1 else patient_id end",
        "provider_id": "case when encounter_id % 19 = 0 then -1 else provider_id end",
        "encounter_type": "case when encounter_id % 23 = 0 then 'visit' else encounter_type end",
        "admission_date": "admission_date",
        "chief_complaint": "coalesce(chief_complaint, '  ')",
        "disposition": "disposition",
    }),
    "diagnoses": (D, {
        "submission_id": "cast(diagnosis_id as string)",
        "encounter_id": "case when diagnosis_id % 29 = 0 then -1 else encounter_id end",
        "icd10_code": "icd10_code",
        "description": "case when diagnosis_id % 31 = 0 then '' else description end",
        "diagnosis_type": "diagnosis_type", "diagnosed_date": "diagnosed_date",
        "status": "case when diagnosis_id % 3 <> 0 then status end",
    }),
    "treatments": (T, {
        "submission_id": "cast(treatment_id as string)",
        "encounter_id": "case when treatment_id % 29 = 0 then -1 else encounter_id end",
        "treatment_type": "treatment_type",
        "treatment_name": "case when treatment_id % 37 = 0 then '' else treatment_name end",
        "start_date": "start_date",
        "dosage": "case when treatment_id % 4 = 0 then '' else dosage end",
        "frequency": "frequency",
        "route": "case when treatment_id % 41 = 0 then 'nasal' else route end",
        "status": "case when treatment_id % 3 <> 0 then status end",
    }),
    "lab_results": (L, {
        "submission_id": "cast(lab_id as string)",
        "encounter_id": "encounter_id",
        "test_name": "case when lab_id % 43 = 0 then '' else test_name end",
        "loinc_code": "loinc_code", "result_value": "result_value", "unit": "unit",
        "reference_low": "cast(case when lab_id % 2 = 0 then 0 else reference_low end as decimal(12,4))",
        "reference_high": "reference_high", "abnormal_flag": "abnormal_flag",
        "collected_date": "cast(collected_date as date)",
    }),
    "adverse_events": (A, {
        "submission_id": "cast(event_id as string)",
        "treatment_id": "case when event_id % 41 = 0 then -1 else treatment_id end",
        "event_type": "event_type", "severity": "severity",
        "ctcae_grade": "case when event_id % 43 = 0 then 9 else ctcae_grade end",
        "onset_date": "onset_date",
        "action_taken": "coalesce(action_taken, '')", "outcome": "outcome",
    }),
}


def submissions(tables: Tables, entity: str) -> DataFrame:
    source, columns = SUBMISSIONS[entity]
    return tables[source].select(*[F.expr(e).alias(c) for c, e in columns.items()])


def _entry(entity: str, check: Callable, against: list[str], shown: list[str], **options):
    return lambda t: check(submissions(t, entity), *[t[n] for n in against], **options).select(
        "submission_id", *shown, "reason")


ENTRY = {
    "ingest_patients": _entry(
        "patients", ingest.ingest_patients, [P],
        ["patient_id", "mrn", "first_name", "zip_code", "primary_language", "is_active"], as_of=AS_OF),
    "ingest_encounters": _entry(
        "encounters", ingest.ingest_encounters, [P, PR],
        ["encounter_id", "patient_id", "provider_id", "chief_complaint"]),
    "ingest_diagnoses": _entry(
        "diagnoses", ingest.ingest_diagnoses, [E],
        ["diagnosis_id", "encounter_id", "patient_id", "icd10_code", "status"]),
    "ingest_treatments": _entry(
        "treatments", ingest.ingest_treatments, [E],
        ["treatment_id", "patient_id", "provider_id", "dosage", "frequency", "status"]),
    "ingest_labs": _entry(
        "lab_results", ingest.ingest_labs, [E],
        ["lab_id", "patient_id", "test_name", "reference_low", "collected_date"]),
    "ingest_labs_zero_as_missing": _entry(
        "lab_results", ingest.ingest_labs, [E],
        ["lab_id", "patient_id", "test_name", "reference_low", "collected_date"],
        zero_reference_is_missing=True),
    "ingest_adverse_events": _entry(
        "adverse_events", ingest.ingest_adverse_events, [T],
        ["event_id", "treatment_id", "patient_id", "ctcae_grade", "action_taken"]),
}

TABLE_VIEWS = {f"table_{name}": (lambda t, n=name: t[n].select(*COLUMNS[n])) for name in COLUMNS}

CATALOG: dict[str, Callable[[Tables], DataFrame]] = {
    **DASHBOARD, **OVERVIEW, **PATIENT, **TREATMENT, **SAFETY, **LABS, **PICKERS, **GRAPH,
    **QUESTIONS, **ENTRY, **TABLE_VIEWS,
}


# --- queries that write: streams and layouts ----------------------------------------------------

def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # several files in no date order, one per micro-batch
    folder = f"{shared_folder(spark)}/events"
    (spark.read.parquet(f"{sf_dir}/events.parquet").repartition(4, F.xxhash64("event_id"))
     .write.parquet(folder))
    return spark.readStream.schema(known).option("maxFilesPerTrigger", 1).parquet(folder)


def stream_lab_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lab submissions as a stream, checked and recorded per micro-batch: all of them, with the reason of the rejected."""
    folder = shared_folder(spark)
    static = clinical_views(spark, sf_dir)
    live = clinical_views(spark, sf_dir, _event_stream(spark, sf_dir))
    source, columns = SUBMISSIONS[L]
    incoming = live[source].select(
        *[F.expr(e).alias(c) for c, e in columns.items()])
    start_entry(incoming, lambda batch, n: ingest.ingest_labs(batch, static[E]), f"{folder}/labs",
                f"{folder}/labs_checkpoint").awaitTermination()
    kept = ["submission_id", "lab_id", "patient_id", "test_name", "reference_low", "collected_date"]
    entered = recorded(spark, f"{folder}/labs").select(*kept, F.lit(None).cast("string").alias("reason"))
    return entered.unionByName(recorded(spark, f"{folder}/labs", "rejected").select(*kept, "reason"))


def stream_ae_surveillance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adverse events as a stream, counted by severity and onset week."""
    folder = shared_folder(spark)
    live = clinical_views(spark, sf_dir, _event_stream(spark, sf_dir))
    start_surveillance(live[A], f"{folder}/windows", f"{folder}/windows_checkpoint").awaitTermination()
    return current(spark, f"{folder}/windows").select(
        F.to_date("window_start").alias("window_start"), F.to_date("window_end").alias("window_end"),
        "severity", "event_count")


#: References of the mapped tables that point to rows the mapping does not have; they are not enforced.
UNCHECKED = {(L, "encounter_id")}


def stored(spark: SparkSession, sf_dir: str, *names: str) -> ClinicStore:
    """The mapped tables, written to a new store: every table in two appends, the second one submitted twice."""
    folder, views = shared_folder(spark), clinical_views(spark, sf_dir)
    store = ClinicStore(spark, f"{folder}/store")
    for name in (n for n in TABLES if n in names):
        table, path = TABLES[name], f"{folder}/mapped/{name}"
        views[name].write.parquet(path)
        rows = spark.read.parquet(path)
        enforced = [c for c, (parent, _) in table.references.items() if parent in names and (name, c) not in UNCHECKED]
        half = F.pmod(F.xxhash64(table.key), F.lit(2))
        for part, append in ((0, "first"), (1, "second"), (1, "second")):
            store.append(name, rows.filter(half == part), append, enforced)
    return store


def layout_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine tables written in appends and read back whole: one row per record with all its mapped values as text."""
    store, result = stored(spark, sf_dir, *TABLES), None
    for name in TABLES:
        frame = to_frame(store.load(name))
        values = [F.unix_micros(c).cast("string") if frame.schema[c].dataType.typeName() == "timestamp"
                  else F.col(c).cast("string") for c in COLUMNS[name]]
        rows = frame.select(F.lit(name).alias("table_name"), F.col(TABLES[name].key).alias("record_id"),
                            F.concat_ws("|", *[F.coalesce(v, F.lit("-")) for v in values]).alias("record"))
        result = rows if result is None else result.union(rows)
    return result


def over_store(query: str, *names: str) -> Callable[[SparkSession, str], DataFrame]:
    """A named query over stored tables, whose months and slices bound what it reads."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = stored(spark, sf_dir, *names)
        df = CATALOG[query]({name: store.table(name) for name in names})
        return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp"
                           else F.col(f.name) for f in df.schema.fields])
    return run


#: Queries by date or abnormal flag, and the tables they read.
STORED = {
    "hba1c_trend": (P, L),
    "abnormal_labs_this_month": (P, L),
    "abnormal_labs": (P, L),
    "recent_high_grade": (P, PR, E, T, A),
    "frequent_visitors": (P, PR, E),
}


WRITERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stream_lab_entry": stream_lab_entry,
    "stream_ae_surveillance": stream_ae_surveillance,
    "layout_roundtrip": layout_roundtrip,
    **{f"stored_{query}": over_store(query, *names) for query, names in STORED.items()},
}


def runners() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries as functions of a session and a folder of the base tables."""

    def over_views(query):
        return lambda spark, sf_dir: query(clinical_views(configure(spark), sf_dir))

    def prepared(query):
        return lambda spark, sf_dir: query(configure(spark), sf_dir)

    return ({name: over_views(q) for name, q in CATALOG.items()}
            | {name: prepared(q) for name, q in WRITERS.items()})
