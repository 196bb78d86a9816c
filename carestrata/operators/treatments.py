"""Treatment efficacy.

Treatments have two independent kinds of children, outcomes and adverse events. Joining both at
once multiplies them (a × b rows per treatment), so every scorecard starts from
:func:`treatment_facts`: each child summed per treatment, then joined, one row per treatment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carestrata.functions.labels import is_serious, service_line
from carestrata.functions.scalars import (
    WIDE, as_date, days_between, mean_of, percent, percent_change, rounded_quotient,
)
from carestrata.functions.series import report_rank
from carestrata.operators.common import for_patient, ids, named_patients, person_name

_OUTCOME_COUNTS = ("outcomes", "improved", "stable", "progression")
_EVENT_COUNTS = ("events", "serious_events")


def _of_type(kind: str) -> Column:
    return F.count_if(F.col("outcome_type") == kind)


def outcome_facts(outcomes: DataFrame) -> DataFrame:
    """Per treatment: outcome counts, and sum and count of both measured values."""
    values = [f(c).alias(f"{name}_{c}") for c in ("baseline_value", "result_value")
              for name, f in (("sum", F.sum), ("n", F.count))]
    return outcomes.groupBy("treatment_id").agg(
        F.count("*").alias("outcomes"), _of_type("improvement").alias("improved"),
        _of_type("stable").alias("stable"), _of_type("progression").alias("progression"), *values)


def event_facts(adverse_events: DataFrame, serious_by: str = "severity") -> DataFrame:
    """Per treatment: adverse events, and the serious ones."""
    return adverse_events.groupBy("treatment_id").agg(
        F.count("*").alias("events"), F.count_if(is_serious(serious_by)).alias("serious_events"))


def treatment_facts(treatments: DataFrame, outcomes: DataFrame | None = None,
                    adverse_events: DataFrame | None = None,
                    serious_by: str = "severity") -> DataFrame:
    """Treatments with their children's counts; one row per treatment, 0 without children."""
    df, counts = treatments, []
    if outcomes is not None:
        df = df.join(outcome_facts(outcomes), "treatment_id", "left")
        counts += _OUTCOME_COUNTS
    if adverse_events is not None:
        df = df.join(event_facts(adverse_events, serious_by), "treatment_id", "left")
        counts += _EVENT_COUNTS
    return df.na.fill(0, counts)


def children_of(children: DataFrame, chosen: DataFrame) -> DataFrame:
    """Only the outcomes or events of chosen treatments: what a filter leaves out is not summed or shuffled."""
    return children.join(ids(chosen, "treatment_id"), "treatment_id", "left_semi")


def efficacy_scorecard(treatments: DataFrame, outcomes: DataFrame, adverse_events: DataFrame,
                       serious_by: str = "severity") -> DataFrame:
    """Patients, outcomes and safety per treatment name and type, best improvement rate first."""
    return (treatment_facts(treatments, outcomes, adverse_events, serious_by)
            .groupBy("treatment_name", "treatment_type")
            .agg(F.countDistinct("patient_id").alias("unique_patients"),
                 *[F.sum(c).alias(c) for c in (*_OUTCOME_COUNTS, *_EVENT_COUNTS)])
            .select("treatment_name", "treatment_type", "unique_patients", "improved", "stable",
                    "progression",
                    percent(F.col("improved"), F.col("outcomes")).alias("improvement_rate_pct"),
                    F.col("events").alias("adverse_event_count"),
                    F.col("serious_events").alias("serious_ae_count"))
            .orderBy(F.desc_nulls_last("improvement_rate_pct"), "treatment_name", "treatment_type"))


def outcome_trends(outcomes: DataFrame, patients: DataFrame, treatments: DataFrame,
                   ordered: bool = True) -> DataFrame:
    """Every assessment with its percent change. The sort key ends in the unique outcome id, so the
    range partitioning can split a patient with very many assessments."""
    df = (outcomes
          .join(named_patients(patients), "patient_id")
          .join(treatments.select("treatment_id", "treatment_name"), "treatment_id"))
    if ordered:
        df = df.orderBy("patient_name", F.asc_nulls_last("outcome_measure"), "assessment_date",
                        "outcome_id")
    return df.select("patient_name", "treatment_name", "outcome_measure", "assessment_date",
                     "baseline_value", "result_value", "unit",
                     percent_change(F.col("baseline_value"), F.col("result_value")).alias("pct_change"))


def treatments_by_type(treatments: DataFrame) -> DataFrame:
    return (treatments.groupBy("treatment_type").agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), "treatment_type"))


def treatment_history(treatments: DataFrame, outcomes: DataFrame, patient_id=None) -> DataFrame:
    """Treatments with their outcomes; a treatment without one appears once."""
    seen = outcomes.select("treatment_id", "outcome_id", "outcome_type", "outcome_measure",
                           "baseline_value", "result_value", "unit")
    df = treatments.join(seen, "treatment_id", "left").select(
        "patient_id", "treatment_id", "treatment_name", "treatment_type", "status", "start_date",
        "end_date", "dosage", "frequency", "outcome_id", "outcome_type", "outcome_measure",
        "baseline_value", "result_value", "unit")
    return for_patient(df, patient_id, [F.desc("start_date"), F.asc("treatment_id"),
                                        F.asc("outcome_id")])


def treatment_history_by_name(treatments: DataFrame, outcomes: DataFrame, patients: DataFrame,
                              name: str) -> DataFrame:
    """History of every patient carrying this full name. The name is looked up first, so only the
    matching patients' treatments reach the outcome join."""
    who = patients.filter(person_name() == F.lit(name)).select("patient_id")
    return treatment_history(treatments.join(who, "patient_id", "left_semi"), outcomes)


# --- treatment analytics page; ``facets`` is a Column from predicates.treatment_facets ----------

def _chosen(treatments: DataFrame, facets: Column | None, *children: DataFrame) -> tuple[DataFrame, ...]:
    if facets is None:
        return treatments, *children
    chosen = treatments.filter(facets)
    return chosen, *[children_of(c, chosen) for c in children]


def treatment_kpis(treatments: DataFrame, outcomes: DataFrame, facets: Column | None = None) -> DataFrame:
    """One row; the improvement rate is 0 when there are no outcomes."""
    chosen, outcomes = _chosen(treatments, facets, outcomes)
    return (treatment_facts(chosen, outcomes)
            .agg(F.count("*").alias("total_treatments"),
                 F.countDistinct("patient_id").alias("unique_patients"),
                 F.coalesce(F.sum("improved"), F.lit(0)).alias("improved"),
                 F.coalesce(F.sum("outcomes"), F.lit(0)).alias("total_outcomes"))
            .withColumn("improvement_rate_pct", F.coalesce(
                percent(F.col("improved"), F.col("total_outcomes")), F.lit(0.0))))


def outcome_distribution(treatments: DataFrame, outcomes: DataFrame,
                         facets: Column | None = None) -> DataFrame:
    """treatment_name, outcome_type, count."""
    chosen, outcomes = _chosen(treatments, facets, outcomes)
    per_treatment = outcomes.groupBy("treatment_id", "outcome_type").agg(F.count("*").alias("n"))
    return (per_treatment.join(chosen.select("treatment_id", "treatment_name"), "treatment_id")
            .groupBy("treatment_name", "outcome_type").agg(F.sum("n").alias("count"))
            .orderBy("treatment_name", "outcome_type"))


def baseline_vs_result(treatments: DataFrame, outcomes: DataFrame, facets: Column | None = None,
                       at_least: int = 2) -> DataFrame:
    """Mean baseline and result of names with enough outcomes."""
    chosen, outcomes = _chosen(treatments, facets, outcomes)
    return (chosen.select("treatment_id", "treatment_name")
            .join(outcome_facts(outcomes), "treatment_id")
            .groupBy("treatment_name")
            .agg(F.sum("outcomes").alias("n"),
                 *[F.sum(c).alias(c) for c in ("sum_baseline_value", "n_baseline_value",
                                               "sum_result_value", "n_result_value")])
            .filter(F.col("n") >= at_least)
            .select("treatment_name",
                    mean_of(F.col("sum_baseline_value"), F.col("n_baseline_value")).alias("avg_baseline"),
                    mean_of(F.col("sum_result_value"), F.col("n_result_value")).alias("avg_result"))
            .orderBy("treatment_name"))


def melted(wide: DataFrame) -> DataFrame:
    """Long form of :func:`baseline_vs_result`: treatment_name, Metric, Value."""
    return wide.unpivot("treatment_name", ["avg_baseline", "avg_result"], "Metric", "Value")


def treatment_detail(treatments: DataFrame, outcomes: DataFrame, adverse_events: DataFrame,
                     facets: Column | None = None, corrected: bool = False) -> DataFrame:
    """Counts and mean values per name, type and status.

    Averaging over treatments joined to both children weighs each outcome by its treatment's
    number of adverse events (1 when there are none). That figure is the default, computed from
    sums; ``corrected`` weighs every outcome once.
    """
    chosen, outcomes, adverse_events = _chosen(treatments, facets, outcomes, adverse_events)
    weight = F.lit(1) if corrected else F.greatest("events", F.lit(1))
    weighted = [F.sum(F.col(c).cast(WIDE) * weight).alias(c)
                for c in ("sum_baseline_value", "sum_result_value")]
    weighted += [F.sum(F.col(c) * weight).alias(c) for c in ("n_baseline_value", "n_result_value")]
    return (treatment_facts(chosen, outcomes, adverse_events)
            .groupBy("treatment_name", "treatment_type", "status")
            .agg(F.countDistinct("patient_id").alias("patients"), F.sum("outcomes").alias("outcomes"),
                 F.sum("events").alias("adverse_events"), *weighted)
            .select("treatment_name", "treatment_type", "status", "patients", "outcomes",
                    "adverse_events",
                    mean_of(F.col("sum_baseline_value"), F.col("n_baseline_value")).alias("avg_baseline"),
                    mean_of(F.col("sum_result_value"), F.col("n_result_value")).alias("avg_result"))
            .orderBy(F.desc("patients"), "treatment_name", "treatment_type", "status"))


# --- questions ----------------------------------------------------------------------------------

def cancer_treatment_outcomes(diagnoses: DataFrame, treatments: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Distinct cancer patients per diagnosis, treatment and outcome type.

    Both sides shrink to what a patient *has* (distinct diagnoses; distinct name and outcome type)
    before they meet, so the join holds each (patient, diagnosis, name, type) once and the distinct
    count is a plain count.
    """
    conditions = (diagnoses.filter(F.col("icd10_code").startswith("C"))
                  .select("patient_id", F.col("description").alias("diagnosis")).distinct())
    results = outcomes.select("treatment_id", "outcome_type").distinct()
    courses = (treatments.select("treatment_id", "patient_id", "treatment_name")
               .join(ids(conditions), "patient_id", "left_semi")
               .join(results, "treatment_id", "left")
               .select("patient_id", "treatment_name", "outcome_type").distinct())
    return (courses.join(conditions, "patient_id")
            .groupBy("diagnosis", "treatment_name", "outcome_type")
            .agg(F.count("*").alias("patient_count"))
            .orderBy(F.desc("patient_count"), "diagnosis", "treatment_name",
                     F.asc_nulls_last("outcome_type")))


def compare_treatments(treatments: DataFrame, outcomes: DataFrame, adverse_events: DataFrame,
                       first: str, second: str) -> DataFrame:
    """metric, first, second, difference: efficacy and safety of two sets of treatments, each
    given by a part of the treatment name. A name matching both counts on both sides."""
    sides = F.array_compact(F.array(*[
        F.when(F.col("treatment_name").ilike(f"%{part}%"), F.lit(i))
        for i, part in enumerate((first, second))]))
    chosen = (treatments.select("treatment_id", "patient_id", "treatment_name")
              .withColumn("side", F.explode(sides)))
    totals = (treatment_facts(chosen, children_of(outcomes, chosen), children_of(adverse_events, chosen)).groupBy("side")
              .agg(F.count("*").alias("treatments"), F.countDistinct("patient_id").alias("patients"),
                   *[F.sum(c).alias(c) for c in (*_OUTCOME_COUNTS, *_EVENT_COUNTS)])
              .select("side", *[F.col(c).cast("double").alias(c) for c in (
                  "patients", "treatments", "outcomes", "events", "serious_events")],
                  percent(F.col("improved"), F.col("outcomes")).alias("improvement_rate_pct"),
                  rounded_quotient(F.col("events"), F.col("patients"), 4).alias("events_per_patient")))
    metrics = [c for c in totals.columns if c != "side"]
    return (totals.unpivot("side", metrics, "metric", "value")
            .groupBy("metric")
            .agg(F.max(F.when(F.col("side") == 0, F.col("value"))).alias("first"),
                 F.max(F.when(F.col("side") == 1, F.col("value"))).alias("second"))
            .withColumn("difference", F.round(F.col("first") - F.col("second"), 4))
            .orderBy("metric"))


def recist_response(treatments: DataFrame, outcomes: DataFrame, diagnoses: DataFrame,
                    encounters: DataFrame, code_prefix: str = "C34",
                    stage: str = "stage iii") -> DataFrame:
    """RECIST response per treatment among patients with the cancer at the stage.

    Response is target-lesion shrinkage of at least 30 %. The stage is only recorded in the chief
    complaint of the encounter where the diagnosis was made.
    """
    staged = (diagnoses.filter(F.col("icd10_code").startswith(code_prefix))
              .join(encounters.filter(F.lower("chief_complaint").contains(stage))
                    .select("encounter_id"), "encounter_id", "left_semi"))
    measured = (outcomes.filter(F.col("outcome_measure").startswith("RECIST"))
                .join(ids(staged), "patient_id", "left_semi")
                .withColumn("pct_change", percent_change(F.col("baseline_value"), F.col("result_value")))
                .filter(F.col("pct_change").isNotNull())
                .groupBy("treatment_id", "patient_id")
                .agg(F.count("*").alias("n"), F.count_if(F.col("pct_change") <= -30).alias("hits"),
                     F.min("pct_change").alias("best")))
    return (measured.join(treatments.select("treatment_id", "treatment_name"), "treatment_id")
            .groupBy("treatment_name")
            .agg(F.countDistinct("patient_id").alias("patients"), F.sum("n").alias("assessments"),
                 F.sum("hits").alias("responses"), F.min("best").alias("best_change_pct"))
            .withColumn("response_rate_pct", percent(F.col("responses"), F.col("assessments")))
            .orderBy(F.desc("response_rate_pct"), "treatment_name"))


def treatment_ranking(treatments: DataFrame, outcomes: DataFrame, adverse_events: DataFrame,
                      diagnoses: DataFrame | None = None, code_prefix: str = "C") -> DataFrame:
    """Scorecard with a rank by improvement rate; with ``diagnoses``, only treatments of patients
    who carry a code under the prefix."""
    if diagnoses is not None:
        cohort = ids(diagnoses.filter(F.col("icd10_code").startswith(code_prefix)))
        treatments = treatments.join(cohort, "patient_id", "left_semi")
        outcomes, adverse_events = children_of(outcomes, treatments), children_of(adverse_events, treatments)
    card = efficacy_scorecard(treatments, outcomes, adverse_events)
    return report_rank(card, "improvement_rate_pct").orderBy("rank", "treatment_name",
                                                                 "treatment_type")


def treatment_durations(treatments: DataFrame, as_of) -> DataFrame:
    """Mean days by type of the treatments begun by ``as_of``; open ones run until then."""
    end = F.coalesce(F.col("end_date"), as_date(as_of))
    begun = treatments.filter(F.col("start_date") <= as_date(as_of))
    done = F.col("status") == "completed"
    days = days_between(end, "start_date")
    return (begun.groupBy("treatment_type")
            .agg(F.count("*").alias("treatments"), F.sum(days).alias("days"),
                 F.count_if(done).alias("completed"), F.sum(F.when(done, days)).alias("done_days"))
            .select("treatment_type", "treatments",
                    mean_of(F.col("days"), F.col("treatments"), 1).alias("avg_days"), "completed",
                    mean_of(F.col("done_days"), F.col("completed"), 1).alias("avg_completed_days"))
            .orderBy("treatment_type"))


def treatment_mix(treatments: DataFrame) -> DataFrame:
    """Distinct patients by type, and each type's share of the sum over types."""
    mix = treatments.groupBy("treatment_type").agg(F.countDistinct("patient_id").alias("patients"))
    return (mix.withColumn("total", F.sum("patients").over(Window.partitionBy()))
            .select("treatment_type", "patients",
                    percent(F.col("patients"), F.col("total")).alias("share_pct"))
            .orderBy(F.desc("patients"), "treatment_type"))


def treatment_success(treatments: DataFrame, outcomes: DataFrame, adverse_events: DataFrame,
                      serious_by: str = "severity") -> DataFrame:
    """Share of *treatments* with at least one improvement, and with at least one serious event."""
    return (treatment_facts(treatments, outcomes, adverse_events, serious_by)
            .agg(F.count("*").alias("treatments"),
                 F.count_if(F.col("improved") > 0).alias("with_improvement"),
                 F.count_if(F.col("serious_events") > 0).alias("with_serious_ae"))
            .withColumn("improvement_pct", percent(F.col("with_improvement"), F.col("treatments")))
            .withColumn("serious_ae_pct", percent(F.col("with_serious_ae"), F.col("treatments"))))


def service_line_efficacy(treatments: DataFrame, outcomes: DataFrame,
                          providers: DataFrame) -> DataFrame:
    """Improvement rate across oncology, cardiology and endocrinology providers."""
    per_provider = (treatment_facts(treatments.select("treatment_id", "provider_id"), outcomes)
                    .groupBy("provider_id")
                    .agg(F.count("*").alias("treatments"), F.sum("outcomes").alias("outcomes"),
                         F.sum("improved").alias("improved")))
    lines = (providers.select("provider_id", service_line(F.col("specialty")).alias("service_line"))
             .filter(F.col("service_line").isNotNull()))
    return (per_provider.join(lines, "provider_id").groupBy("service_line")
            .agg(*[F.sum(c).alias(c) for c in ("treatments", "outcomes", "improved")])
            .withColumn("improvement_rate_pct", percent(F.col("improved"), F.col("outcomes")))
            .orderBy(F.desc_nulls_last("improvement_rate_pct"), "service_line"))
