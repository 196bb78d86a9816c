"""Laboratory results: flags, abnormality rates, and series over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carestrata.functions.bounds import in_days, only_abnormal
from carestrata.functions.labels import flag_label
from carestrata.functions.predicates import abnormal, patient_search
from carestrata.functions.scalars import as_date, exact_slope, percent
from carestrata.functions.series import SLICE_ROWS, previous
from carestrata.operators.common import for_patient, ids, named_patients, person_name, top_with

_MEASURE = ["result_value", "unit", "reference_low", "reference_high", "abnormal_flag"]


def _filtered(labs: DataFrame, facets: Column | None) -> DataFrame:
    return labs if facets is None else labs.filter(facets)


def _newest() -> list[Column]:
    return [F.desc("collected_date"), F.asc("lab_id")]


def abnormal_labs(labs: DataFrame, patients: DataFrame, k: int = 200) -> DataFrame:
    """Latest abnormal results; the ``k`` rows are chosen before patients are joined."""
    flagged = only_abnormal(labs).select("lab_id", "patient_id", "test_name", "collected_date",
                                             *_MEASURE)
    return (top_with(flagged, _newest(), k, (named_patients(patients), "patient_id"))
            .select("patient_name", "test_name", "collected_date", *_MEASURE))


def lab_kpis(labs: DataFrame) -> DataFrame:
    """Two distinct counts: rows shrink to one per patient and test before they are taken."""
    pairs = labs.groupBy("patient_id", "test_name").agg(
        F.count("*").alias("n"), F.count_if(abnormal()).alias("bad"))
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_results"),
        F.countDistinct("patient_id").alias("patients_tested"),
        F.countDistinct("test_name").alias("unique_tests"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("abnormal_count"))


def lab_flag_distribution(labs: DataFrame, facets: Column | None = None) -> DataFrame:
    """flag_label, count; results without a flag are a group of their own."""
    return (_filtered(labs, facets).groupBy("abnormal_flag").agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_last("abnormal_flag"))
            .select(flag_label(F.col("abnormal_flag")).alias("flag_label"), "count"))


def top_abnormal_tests(labs: DataFrame, k: int = 10) -> DataFrame:
    return (labs.groupBy("test_name")
            .agg(F.count_if(abnormal()).alias("abnormal"), F.count("*").alias("total"))
            .filter(F.col("abnormal") > 0)
            .withColumn("abnormal_pct", percent(F.col("abnormal"), F.col("total")))
            .orderBy(F.desc("abnormal"), "test_name").limit(k))


def patients_with_labs(patients: DataFrame, labs: DataFrame, term: str, k: int = 20) -> DataFrame:
    """Search among patients, active or not, who have at least one result."""
    return (patients.filter(patient_search(term)).join(ids(labs), "patient_id", "left_semi")
            .select("patient_id", "mrn", person_name().alias("name")).orderBy("mrn").limit(k))


def lab_detail(labs: DataFrame, patients: DataFrame, facets: Column | None = None,
               k: int = 100) -> DataFrame:
    chosen = _filtered(labs, facets).select("lab_id", "patient_id", "test_name", "loinc_code",
                                            *_MEASURE, "collected_date")
    return (top_with(chosen, _newest(), k, (named_patients(patients, "mrn"), "patient_id"))
            .select("mrn", "patient_name", "test_name", "loinc_code", *_MEASURE, "collected_date"))


def lab_history(labs: DataFrame, patient_id=None) -> DataFrame:
    df = labs.select("patient_id", "lab_id", "test_name", "loinc_code", *_MEASURE, "collected_date")
    return for_patient(df, patient_id, _newest())


def lab_trends(labs: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Every point of every patient × test series with the change since the point before.

    A very long series is worked through by clock hour, and a crowded hour in pieces of (time, id).
    """
    points = labs.select("patient_id", "test_name", "lab_id", "collected_date", *_MEASURE)
    hour = F.floor(F.unix_seconds(F.col("collected_date").cast("timestamp")) / 3600)
    series = previous(points, ["patient_id", "test_name"], ["collected_date", "lab_id"],
                      "result_value", hour, slice_rows=slice_rows)
    return (series.withColumn("delta", F.col("result_value") - F.col("previous_value"))
            .select("patient_id", "test_name", "lab_id", "collected_date", *_MEASURE,
                    "previous_value", "delta"))


def lab_series(labs: DataFrame) -> DataFrame:
    """One row per series: extent, first and last value, slope per day, and reference band.

    The band is the earliest one recorded in the series. Everything is an aggregate that combines
    before the shuffle, so long series cost no more than short ones.
    """
    at = F.struct("collected_date", "lab_id")

    def earliest(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column).isNotNull(), at))

    day = F.unix_date(F.to_date("collected_date"))
    return (labs.groupBy("patient_id", "test_name")
            .agg(F.count("*").alias("points"), F.count_if(abnormal()).alias("abnormal"),
                 F.min("collected_date").alias("first_collected"),
                 F.max("collected_date").alias("last_collected"),
                 F.min_by("result_value", at).alias("first_value"),
                 F.max_by("result_value", at).alias("last_value"),
                 F.round(exact_slope(F.col("result_value"), day, 4), 6).alias("slope_per_day"),
                 earliest("reference_low").alias("band_low"),
                 earliest("reference_high").alias("band_high"))
            .withColumn("change", F.col("last_value") - F.col("first_value")))


def recent_trend(labs: DataFrame, patients: DataFrame, test_name: str, as_of, months: int = 6,
                 mrn: str | None = None) -> DataFrame:
    """Series of one test over the last months, of one patient by MRN or of everyone."""
    end = as_date(as_of)
    window = in_days(labs.filter(F.col("test_name") == test_name), "collected_date",
                     F.add_months(end, -months), F.date_add(end, 1))
    people = patients.select("patient_id", "mrn")
    if mrn is not None:
        people = people.filter(F.col("mrn") == mrn)
        window = window.join(people, "patient_id", "left_semi")
    return (lab_trends(window).join(people, "patient_id")
            .select("mrn", "test_name", "lab_id", "collected_date", "result_value", "unit", "delta"))


def abnormal_this_month(labs: DataFrame, patients: DataFrame, as_of) -> DataFrame:
    """Patients with abnormal results in the calendar month of ``as_of``."""
    start = F.trunc(as_date(as_of), "month")
    month = in_days(only_abnormal(labs), "collected_date", start, F.add_months(start, 1))
    per_patient = month.groupBy("patient_id").agg(
        F.count("*").alias("abnormal_results"),
        F.count_if(F.col("abnormal_flag").isin("HH", "LL")).alias("critical_results"),
        F.max("collected_date").alias("latest"))
    return (per_patient.join(named_patients(patients, "mrn"), "patient_id")
            .select("patient_id", "mrn", "patient_name", "abnormal_results", "critical_results", "latest")
            .orderBy(F.desc("abnormal_results"), "mrn"))
