"""Adverse events: monitoring, rates, and what was done about them.

Events are summed per treatment before they meet the treatments, so neither a treatment with very
many events nor a popular treatment name loads one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carestrata.functions.bounds import in_days
from carestrata.functions.labels import is_serious, severity_rank
from carestrata.functions.scalars import (
    as_date, days_between, exact_slope, mean_of, month_index, percent, rounded_quotient)
from carestrata.operators.common import for_patient, ids, named_patients, top_with
from carestrata.operators.treatments import event_facts, treatment_facts


def _filtered(adverse_events: DataFrame, facets: Column | None) -> DataFrame:
    return adverse_events if facets is None else adverse_events.filter(facets)


def _names(treatments: DataFrame) -> DataFrame:
    return treatments.select("treatment_id", "treatment_name")


def ae_monitor(adverse_events: DataFrame, treatments: DataFrame) -> DataFrame:
    """Events per treatment name, type, severity and grade; mean duration of the resolved ones."""
    kind = ["event_type", "severity", "ctcae_grade"]
    per_treatment = adverse_events.groupBy("treatment_id", *kind).agg(
        F.count("*").alias("n"), F.count("resolution_date").alias("resolved"),
        F.sum(days_between("resolution_date", "onset_date")).alias("days"))
    return (per_treatment.join(_names(treatments), "treatment_id")
            .groupBy("treatment_name", *kind)
            .agg(F.sum("n").alias("event_count"),
                 mean_of(F.sum("days"), F.sum("resolved"), 1).alias("avg_duration_days"))
            .orderBy(F.desc_nulls_first("ctcae_grade"), F.desc("event_count"), "treatment_name",
                     "event_type", "severity"))


def ae_by_severity(adverse_events: DataFrame) -> DataFrame:
    """severity, event_count, mildest first."""
    return (adverse_events.groupBy("severity").agg(F.count("*").alias("event_count"))
            .orderBy(F.asc_nulls_last(severity_rank(F.col("severity"))), "severity"))


def ae_kpis(adverse_events: DataFrame) -> DataFrame:
    return adverse_events.agg(
        F.count("*").alias("total_events"), F.countDistinct("patient_id").alias("affected_patients"),
        F.count_if(is_serious("severity")).alias("serious_count"),
        F.count_if(F.col("resolution_date").isNull()).alias("unresolved"))


def ae_severity_ranked(adverse_events: DataFrame, facets: Column | None = None) -> DataFrame:
    """severity, count, worst first."""
    return (_filtered(adverse_events, facets).groupBy("severity").agg(F.count("*").alias("count"))
            .orderBy(F.desc_nulls_last(severity_rank(F.col("severity"))), "severity"))


def ae_top_treatments(adverse_events: DataFrame, treatments: DataFrame,
                      facets: Column | None = None, k: int = 15) -> DataFrame:
    per_treatment = (_filtered(adverse_events, facets)
                     .groupBy("treatment_id").agg(F.count("*").alias("n")))
    return (per_treatment.join(_names(treatments), "treatment_id")
            .groupBy("treatment_name").agg(F.sum("n").alias("count"))
            .orderBy(F.desc("count"), "treatment_name").limit(k))


def ae_grade_distribution(adverse_events: DataFrame, facets: Column | None = None) -> DataFrame:
    return (_filtered(adverse_events, facets).groupBy("ctcae_grade", "event_type")
            .agg(F.count("*").alias("count"))
            .orderBy(F.asc_nulls_last("ctcae_grade"), "event_type"))


_DETAIL = ["event_id", "mrn", "patient_name", "treatment_name", "event_type", "severity",
           "ctcae_grade", "onset_date", "resolution_date", "action_taken", "outcome"]


def ae_detail(adverse_events: DataFrame, patients: DataFrame, treatments: DataFrame,
              facets: Column | None = None, k: int = 100) -> DataFrame:
    """Latest events with patient and treatment; only the chosen ``k`` rows are joined."""
    order = [F.desc("onset_date"), F.asc("event_id")]
    chosen = _filtered(adverse_events, facets).select(
        "patient_id", "treatment_id", *[c for c in _DETAIL if c in adverse_events.columns])
    return top_with(chosen, order, k, (_names(treatments), "treatment_id"),
                    (named_patients(patients, "mrn"), "patient_id")).select(*_DETAIL)


def ae_history(adverse_events: DataFrame, treatments: DataFrame, patient_id=None) -> DataFrame:
    df = adverse_events.join(_names(treatments), "treatment_id").select(
        "patient_id", "event_id", "event_type", "severity", "ctcae_grade", "onset_date",
        "resolution_date", "action_taken", "outcome", "treatment_name")
    return for_patient(df, patient_id, [F.desc("onset_date"), F.asc("event_id")])


# --- questions ----------------------------------------------------------------------------------

_EVENT = ["event_id", "patient_id", "treatment_id", "event_type", "severity", "ctcae_grade",
          "onset_date"]


def events_of_treatment(adverse_events: DataFrame, treatments: DataFrame, name: str) -> DataFrame:
    """Events attributed to treatments whose name contains the text."""
    chosen = treatments.filter(F.col("treatment_name").ilike(f"%{name}%")).select("treatment_id")
    return adverse_events.select(*_EVENT).join(chosen, "treatment_id", "left_semi").select(*_EVENT)


def events_of_patients_on(adverse_events: DataFrame, treatments: DataFrame, name: str) -> DataFrame:
    """Every event of patients who take such a treatment, whatever it is attributed to."""
    takers = ids(treatments.filter(F.col("treatment_name").ilike(f"%{name}%")))
    return adverse_events.select(*_EVENT).join(takers, "patient_id", "left_semi").select(*_EVENT)


def dose_reduction_outcomes(adverse_events: DataFrame, treatments: DataFrame,
                            outcomes: DataFrame) -> DataFrame:
    """Outcomes assessed on or after a treatment's first dose reduction for an adverse event."""
    reduced = (adverse_events.filter(F.lower("action_taken").contains("dose reduc"))
               .groupBy("treatment_id")
               .agg(F.count("*").alias("dose_reductions"), F.min("onset_date").alias("first_reduction")))
    return (outcomes.join(reduced, "treatment_id").filter("assessment_date >= first_reduction")
            .join(_names(treatments), "treatment_id")
            .select("patient_id", "treatment_id", "treatment_name", "dose_reductions",
                    "first_reduction", "outcome_id", "outcome_type", "assessment_date"))


def serious_rate_above(treatments: DataFrame, adverse_events: DataFrame, threshold_pct: float = 20,
                       serious_by: str = "severity") -> DataFrame:
    """Names where more than the threshold of treatments had a serious event."""
    return (treatment_facts(treatments, None, adverse_events, serious_by)
            .groupBy("treatment_name")
            .agg(F.count("*").alias("treatments"),
                 F.count_if(F.col("serious_events") > 0).alias("with_serious_ae"))
            .filter(F.col("with_serious_ae") * 100 > F.col("treatments") * threshold_pct)
            .withColumn("serious_rate_pct", percent(F.col("with_serious_ae"), F.col("treatments")))
            .orderBy(F.desc("serious_rate_pct"), "treatment_name"))


def recent_high_grade(adverse_events: DataFrame, patients: DataFrame, treatments: DataFrame, as_of,
                      days: int = 90, grade: int = 3) -> DataFrame:
    """All events of the grade or above with onset in the days up to ``as_of``."""
    end = as_date(as_of)
    chosen = in_days(adverse_events.filter(F.col("ctcae_grade") >= grade), "onset_date",
                     F.date_sub(end, days), F.date_add(end, 1))
    return (chosen.join(_names(treatments), "treatment_id")
            .join(named_patients(patients, "mrn"), "patient_id").select(*_DETAIL))


def ae_rate_per_patient(treatments: DataFrame, adverse_events: DataFrame) -> DataFrame:
    """Events per distinct patient by treatment name, highest first."""
    return (treatment_facts(treatments, None, adverse_events)
            .groupBy("treatment_name")
            .agg(F.countDistinct("patient_id").alias("patients"),
                 F.sum("events").alias("adverse_events"))
            .withColumn("events_per_patient",
                        rounded_quotient(F.col("adverse_events"), F.col("patients"), 4))
            .orderBy(F.desc("events_per_patient"), "treatment_name"))


def actions_for_severe(adverse_events: DataFrame, severity: str = "severe") -> DataFrame:
    return (adverse_events.filter(F.col("severity") == severity)
            .groupBy("action_taken").agg(F.count("*").alias("event_count"))
            .orderBy(F.desc("event_count"), F.asc_nulls_last("action_taken")))


def mean_event_rate(treatments: DataFrame, adverse_events: DataFrame) -> DataFrame:
    """Events per treatment over all treatments, those without events included."""
    return (treatments.select("treatment_id").join(event_facts(adverse_events), "treatment_id", "left")
            .agg(F.count("*").alias("treatments"), F.count("events").alias("with_events"),
                 F.coalesce(F.sum("events"), F.lit(0)).alias("adverse_events"))
            .withColumn("events_per_treatment",
                        rounded_quotient(F.col("adverse_events"), F.col("treatments"), 4)))


def event_rate_trend(treatments: DataFrame, adverse_events: DataFrame, as_of) -> DataFrame:
    """Is a treatment's monthly event rate rising? Slope of events per course under way, by name.

    Courses under way in a month are counted from starts and ends summed per month, so no course is
    spread out over its months. The windows run over months: a few thousand rows at most per name. Rates are
    taken to twelve decimal places and summed as whole numbers, so the slope does not depend on the order of rows.
    """
    last = month_index(as_date(as_of))
    begin = month_index(F.col("start_date"))
    end = F.least(month_index(F.coalesce(F.col("end_date"), as_date(as_of))), last)
    begun = treatments.filter(F.col("start_date") <= as_date(as_of))
    steps = F.array(
        F.struct(begin.alias("month"), F.lit(1).alias("starts"), F.lit(0).alias("ends")),
        F.struct(F.greatest(end, begin).alias("month"), F.lit(0).alias("starts"), F.lit(1).alias("ends")))
    flow = (begun.select("treatment_name", F.explode(steps).alias("s"))
            .select("treatment_name", "s.*").withColumn("events", F.lit(0)))
    onset = (adverse_events.filter(F.col("onset_date") <= as_date(as_of))
             .groupBy("treatment_id", month_index(F.col("onset_date")).alias("month"))
             .agg(F.count("*").alias("events"))
             .join(_names(treatments), "treatment_id")
             .select("treatment_name", "month", F.lit(0).alias("starts"), F.lit(0).alias("ends"), "events"))
    changes = (flow.unionByName(onset).groupBy("treatment_name", "month")
               .agg(*[F.sum(c).alias(c) for c in ("starts", "ends", "events")]))
    # months without any change still count: every month from a name's first one on
    calendar = (changes.groupBy("treatment_name").agg(F.min("month").alias("first"))
                .select("treatment_name", F.explode(F.sequence("first", last)).alias("month")))
    monthly = (calendar.join(changes, ["treatment_name", "month"], "left")
               .na.fill(0, ["starts", "ends", "events"]))
    so_far = Window.partitionBy("treatment_name").orderBy("month")
    under_way = (F.sum("starts").over(so_far.rowsBetween(Window.unboundedPreceding, 0))
                 - F.coalesce(F.sum("ends").over(so_far.rowsBetween(Window.unboundedPreceding, -1)),
                              F.lit(0)))
    rates = (monthly.withColumn("courses", under_way).filter(F.col("courses") > 0)
             .withColumn("rate", (F.col("events").cast("decimal(18,0)") / F.col("courses").cast("decimal(18,0)"))
                         .cast("decimal(28,12)")))
    return (rates.groupBy("treatment_name")
            .agg(F.count("*").alias("months"), F.sum("events").alias("adverse_events"),
                 F.round(exact_slope(F.col("rate"), F.col("month"), 12), 6).alias("rate_slope"))
            .withColumn("rising", F.col("rate_slope") > 0)
            .orderBy(F.desc_nulls_last("rate_slope"), "treatment_name"))
