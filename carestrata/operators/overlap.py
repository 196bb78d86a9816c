"""Treatments of one patient that run at the same time.

Listing every overlapping pair grows with the square of a patient's treatments. Here each treatment
gets the number it overlaps with and the episode it belongs to (a stretch of days with something
always under way), one row per treatment. Both follow from starts and ends counted per patient and
day: a treatment [s, e] overlaps everything begun by e, less everything over before s, less itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carestrata.functions.scalars import as_date
from carestrata.operators.common import ids


def concurrent_treatments(treatments: DataFrame, as_of) -> DataFrame:
    """patient_id, treatment_id, treatment_name, start_date, until, episode, overlapping.

    Intervals include both ends; an open treatment runs until ``as_of``.
    """
    until = F.greatest(F.coalesce(F.col("end_date"), as_date(as_of)), F.col("start_date"))
    courses = treatments.select("patient_id", "treatment_id", "treatment_name", "start_date",
                                until.alias("until"))
    edges = F.array(
        F.struct(F.col("start_date").alias("day"), F.lit(1).alias("starts"), F.lit(0).alias("ends")),
        F.struct(F.col("until").alias("day"), F.lit(0).alias("starts"), F.lit(1).alias("ends")))
    days = (courses.select("patient_id", F.explode(edges).alias("e")).select("patient_id", "e.*")
            .groupBy("patient_id", "day").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends")))
    by_day = Window.partitionBy("patient_id").orderBy("day")
    before = by_day.rowsBetween(Window.unboundedPreceding, -1)
    through = by_day.rowsBetween(Window.unboundedPreceding, 0)
    counts = days.select(
        "patient_id", "day",
        F.sum("starts").over(through).alias("begun"),
        F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("over"),
        (F.coalesce(F.sum("starts").over(before), F.lit(0))
         == F.coalesce(F.sum("ends").over(before), F.lit(0))).cast("int").alias("fresh"))
    counts = counts.withColumn("episode", F.sum("fresh").over(through))
    # file sizes tell little of how many days there are, so these are never held whole
    at_start = counts.select("patient_id", F.col("day").alias("start_date"), "over", "episode").hint("merge")
    at_end = counts.select("patient_id", F.col("day").alias("until"), "begun").hint("merge")
    return (courses.join(at_start, ["patient_id", "start_date"]).join(at_end, ["patient_id", "until"])
            .select("patient_id", "treatment_id", "treatment_name", "start_date", "until", "episode",
                    (F.col("begun") - F.col("over") - 1).alias("overlapping")))


def comorbid_overlaps(treatments: DataFrame, diagnoses: DataFrame, as_of, first: str = "E11",
                      second: str = "C") -> DataFrame:
    """Overlapping treatments of patients who carry codes under both prefixes."""
    cohort = treatments
    for prefix in (first, second):
        cohort = cohort.join(ids(diagnoses.filter(F.col("icd10_code").startswith(prefix))),
                             "patient_id", "left_semi")
    return concurrent_treatments(cohort, as_of).filter(F.col("overlapping") > 0)
