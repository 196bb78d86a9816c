"""Time the headline queries.

The nine clinical tables are first derived and written in their layout (``stage_sec``); queries then read
them, each run to the end without collecting, once to warm up and three times for the median. With
``--naive`` the definitions multiplied out (tests/naive.py) are timed next to the operators.

One JSON line is printed. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from carestrata.plans.catalog import CATALOG
from carestrata.plans.session import configure, shared_folder
from carestrata.sources.retail_mapping import clinical_views
from carestrata.sources.tables import write_layout

HEADLINE = [
    "age_distribution", "efficacy_scorecard", "outcome_trends", "ae_monitor", "provider_activity",
    "diagnosis_cohorts", "abnormal_labs", "kpi_cards", "cancer_treatment_outcomes", "recent_encounters",
    "treatment_kpis", "treatment_detail", "ae_detail", "lab_trends", "lab_series", "patient_profiles",
    "graph_edges", "graph_layout", "treatment_ranking", "comorbid_overlaps", "mean_time_to_treatment",
    "event_rate_trend", "readmission_rates", "ingest_patients", "ingest_labs",
]
NAIVE = {
    "efficacy_scorecard": ("treatments", "treatment_outcomes", "adverse_events"),
    "treatment_detail": ("treatments", "treatment_outcomes", "adverse_events"),
    "provider_activity": ("providers", "encounters", "treatments"),
    "cancer_treatment_outcomes": ("diagnoses", "treatments", "treatment_outcomes"),
}


def seconds(build, runs: int = 3) -> float:
    def once() -> float:
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    once()
    return round(statistics.median(once() for _ in range(runs)), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]").appName("carestrata-bench")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.log.level", "ERROR").getOrCreate())
    folder = shared_folder(spark)
    start = time.perf_counter()
    views = clinical_views(spark, sf_dir)
    for name in views:
        write_layout(views[name], folder, name)
    stage = round(time.perf_counter() - start, 3)
    tables = {name: spark.read.parquet(f"{folder}/{name}").drop("year") for name in views}

    queries = {name: seconds(lambda n=name: CATALOG[n](tables)) for name in HEADLINE}
    report = {
        "metric": "sum of median warm query times", "value": round(sum(queries.values()), 3), "unit": "sec",
        "queries": queries, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "stage_sec": stage,
    }
    if "--naive" in sys.argv:
        from tests import naive
        report["naive"] = {name: seconds(lambda n=name, a=args: getattr(naive, n)(*[tables[t] for t in a]))
                           for name, args in NAIVE.items()}
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
