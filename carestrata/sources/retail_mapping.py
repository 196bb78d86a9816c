"""The nine clinical tables derived from the TPC-H-like Parquet tables used for checking.

Each column is one SQL expression that reads the same in Spark and in standard SQL, so the
same text also builds the tables in the checking database. ``TS`` stands for the zone-less
timestamp type, which the two spell differently.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carestrata.plans.session import release_shuffles, shared_folder

# The mapping's column expressions, table by table.
COLUMNS: dict[str, dict[str, str]] = {
    "patients": {
        "patient_id": "c_custkey",
        "mrn": "concat('MRN-', lpad(cast(c_custkey as string), 6, '0'))",
        "first_name": "case c_custkey % 5 when 0 then 'Ana' when 1 then 'Ben' when 2 then 'Chi' when 3 then 'Dev' else 'Eva' end",
        "last_name": "concat('P', split_part(c_name, '#', 2))",
        "date_of_birth": "cast(DATE '1915-01-01' + cast((c_custkey * 7919) % 27000 as int) as date)",
        "gender": "case c_custkey % 3 when 0 then 'Female' when 1 then 'Male' else 'Other' end",
        "race": "case c_custkey % 4 when 0 then 'White' when 1 then 'Black or African American' when 2 then 'Asian' end",
        "ethnicity": "case when c_custkey % 5 = 0 then 'Hispanic/Latino' else 'Not Hispanic' end",
        "insurance_type": "case c_mktsegment when 'BUILDING' then 'Medicare' when 'AUTOMOBILE' then 'Commercial' when 'MACHINERY' then 'Medicaid' when 'FURNITURE' then 'Self-pay' end",
        "zip_code": "concat('606', lpad(cast(c_nationkey as string), 2, '0'))",
        "is_active": "c_acctbal >= 0",
        "created_at": "cast(cast(DATE '2000-01-01' + cast(c_custkey % 600 as int) as date) as TS)",
    },
    "providers": {
        "provider_id": "s_suppkey",
        "npi": "lpad(cast(s_suppkey as string), 10, '1')",
        "first_name": "case s_suppkey % 3 when 0 then 'Sam' when 1 then 'Lee' else 'Kim' end",
        "last_name": "concat('D', split_part(s_name, '#', 2))",
        "specialty": "case s_suppkey % 6 when 0 then 'Medical Oncology' when 1 then 'Cardiology' when 2 then 'Endocrinology' when 3 then 'Radiation Oncology' when 4 then 'Neurology' else 'General Surgery' end",
        "department": "case s_suppkey % 6 when 0 then 'Cancer Center' when 1 then 'Heart & Vascular' when 2 then 'Diabetes Center' when 3 then 'Cancer Center' when 4 then 'Neurosciences' end",
        "facility_name": "n_name",
        "is_active": "s_acctbal >= 0",
    },
    "encounters": {
        "encounter_id": "o_orderkey",
        "patient_id": "o_custkey",
        "provider_id": "o_orderkey % n_sup",
        "encounter_type": "case substr(o_orderpriority, 1, 1) when '1' then 'emergency' when '2' then 'inpatient' when '4' then 'telehealth' else 'outpatient' end",
        "admission_date": "o_orderdate",
        "discharge_date": "case when substr(o_orderpriority, 1, 1) in ('1', '2') then cast(cast(cast(o_orderdate as date) + cast(1 + o_orderkey % 9 as int) as date) as TS) end",
        "chief_complaint": "case o_orderkey % 4 when 0 then 'Stage IIIA review' when 1 then 'Follow-up' when 2 then 'Acute dyspnea' end",
        "disposition": "case o_orderstatus when 'F' then 'discharged' when 'O' then 'admitted' else 'transferred' end",
        "created_at": "o_orderdate",
    },
    "diagnoses": {
        "diagnosis_id": "o_orderkey * 2 + k",
        "encounter_id": "o_orderkey",
        "patient_id": "o_custkey",
        "icd10_code": "case (o_orderkey * 31 + k) % 8 when 0 then 'C50.911' when 1 then 'E11.65' when 2 then 'I10' when 3 then 'C61' when 4 then 'I50.9' when 5 then 'E11.9' when 6 then 'C34.90' else 'E78.5' end",
        "description": "case (o_orderkey * 31 + k) % 8 when 0 then 'Breast cancer' when 1 then 'Type 2 diabetes with hyperglycemia' when 2 then 'Essential hypertension' when 3 then 'Prostate cancer' when 4 then 'Heart failure, unspecified' when 5 then 'Type 2 diabetes' when 6 then 'Lung cancer' else 'Dyslipidemia, unspecified' end",
        "diagnosis_type": "case k when 0 then 'primary' else 'secondary' end",
        "diagnosed_date": "cast(o_orderdate as date)",
        "resolved_date": "case when o_orderstatus = 'F' then cast(cast(o_orderdate as date) + 30 as date) end",
        "status": "case o_orderstatus when 'O' then 'active' when 'F' then 'resolved' else 'chronic' end",
    },
    "treatments": {
        "treatment_id": "l_orderkey * 10 + l_linenumber",
        "encounter_id": "l_orderkey",
        "patient_id": "o_custkey",
        "provider_id": "min(l_suppkey)",
        "treatment_type": "case min(p_type) when 'LARGE' then 'surgery' when 'MEDIUM' then 'procedure' when 'PROMO' then 'therapy' else 'medication' end",
        "treatment_name": "min(p_name)",
        "start_date": "cast(min(l_shipdate) as date)",
        "end_date": "case when min(l_linestatus) = 'F' then cast(cast(min(l_shipdate) as date) + cast(max(l_quantity) as int) as date) end",
        "dosage": "concat(cast(cast(max(l_quantity) as int) as string), 'mg')",
        "frequency": "case l_linenumber % 3 when 0 then 'once daily' when 1 then 'twice daily' end",
        "route": "case l_linenumber % 3 when 0 then 'oral' when 1 then 'IV' else 'subcutaneous' end",
        "status": "case when min(l_linestatus) = 'O' then 'active' when (l_orderkey * 10 + l_linenumber) % 5 = 0 then 'discontinued' else 'completed' end",
    },
    "medications": {
        "medication_id": "treatment_id",
        "treatment_id": "treatment_id",
        "patient_id": "patient_id",
        "drug_name": "treatment_name",
        "generic_name": "upper(treatment_name)",
        "dosage_form": "case route when 'oral' then 'tablet' else 'injection' end",
        "strength": "dosage",
        "quantity": "cast(30 * (1 + treatment_id % 3) as int)",
        "refills_remaining": "cast(treatment_id % 6 as int)",
        "prescribed_date": "start_date",
        "prescriber_id": "provider_id",
    },
    "treatment_outcomes": {
        "outcome_id": "treatment_id * 10 + k",
        "treatment_id": "treatment_id",
        "patient_id": "patient_id",
        "outcome_type": "case (treatment_id + k) % 5 when 0 then 'stable' when 1 then 'progression' when 2 then 'remission' else 'improvement' end",
        "outcome_measure": "case treatment_id % 5 when 0 then 'HbA1c' when 1 then 'RECIST 1.1 (target lesion)' when 2 then 'LVEF (echocardiogram)' when 3 then 'PSA' end",
        "baseline_value": "case when treatment_id % 7 <> 0 then cast(cast((treatment_id * 13 + 7) % 500 as decimal(10,2)) * cast(0.25 as decimal(10,2)) as decimal(10,2)) end",
        "result_value": "cast(cast((treatment_id * 37 + k * 11) % 500 as decimal(10,2)) * cast(0.25 as decimal(10,2)) as decimal(10,2))",
        "unit": "case treatment_id % 5 when 0 then '%' when 1 then 'mm' when 2 then '%' when 3 then 'ng/mL' end",
        "assessment_date": "cast(start_date + cast(30 * k as int) as date)",
    },
    "adverse_events": {
        "event_id": "event_id",
        "treatment_id": "treatment_id",
        "patient_id": "patient_id",
        "event_type": "case event_id % 6 when 0 then 'Nausea' when 1 then 'Neutropenia' when 2 then 'Fatigue' when 3 then 'Rash' when 4 then 'Diarrhea' else 'Hypothyroidism' end",
        "severity": "case event_type when 'view' then 'mild' when 'click' then 'moderate' when 'error' then 'moderate' when 'signup' then 'severe' else 'life-threatening' end",
        "ctcae_grade": "case when event_id % 11 <> 0 then cast(1 + event_id % 5 as int) end",
        "onset_date": "cast(start_date + cast(event_id % 60 as int) as date)",
        "resolution_date": "case when event_id % 4 <> 0 then cast(start_date + cast(event_id % 60 + event_id % 20 as int) as date) end",
        "action_taken": "case event_id % 5 when 0 then 'Dose reduced' when 1 then 'Discontinued' when 2 then 'Dose maintained' when 3 then 'Supportive care' end",
        "outcome": "case when event_id % 4 = 0 then 'ongoing' when event_id % 97 = 1 then 'fatal' else 'resolved' end",
    },
    "lab_results": {
        "lab_id": "event_id",
        "encounter_id": "case when event_id % 3 <> 0 then event_id end",
        "patient_id": "user_id",
        "test_name": "case event_type when 'view' then 'HbA1c' when 'click' then 'Creatinine' when 'signup' then 'BNP' when 'purchase' then 'PSA' else 'LDL Cholesterol' end",
        "loinc_code": "case event_type when 'view' then '4548-4' when 'click' then '2160-0' when 'signup' then '42637-9' when 'purchase' then '2857-1' end",
        "result_value": "cast(value as decimal(12,4))",
        "unit": "case event_type when 'view' then '%' when 'click' then 'mg/dL' when 'signup' then 'pg/mL' when 'purchase' then 'ng/mL' else 'mg/dL' end",
        "reference_low": "case when event_id % 13 <> 0 then cast(5 as decimal(12,4)) end",
        "reference_high": "cast(100 as decimal(12,4))",
        "abnormal_flag": "case when event_id % 97 = 0 then null when value < 1 then 'LL' when value < 5 then 'L' when value <= 100 then 'N' when value <= 200 then 'H' else 'HH' end",
        "collected_date": "ts",
    },
}

# Columns the mapping leaves out, by table; NULL of these types.
_ABSENT = {
    "encounters": {"facility_name": "string"},
    "treatments": {"cpt_code": "string"},
    "medications": {"ndc_code": "string", "expiration_date": "date"},
}

AS_OF = "2001-08-01"
LABS_AS_OF = "2024-01-31"


def _expressions(name: str) -> list:
    absent = [F.lit(None).cast(t).alias(c) for c, t in _ABSENT.get(name, {}).items()]
    return [F.expr(e.replace("TS", "timestamp_ntz")).alias(c)
            for c, e in COLUMNS[name].items()] + absent


def _treatments(base) -> DataFrame:
    """Line items with a repeated (order, line) collapse into one treatment."""
    lines = (
        base("lineitem").withColumn("l_shipdate", F.to_date("l_shipdate"))  # days order and move like the times, in less
        .join(base("part").select("p_partkey", "p_name", "p_type"),
              F.col("l_partkey") == F.col("p_partkey"))
        .join(base("orders").select("o_orderkey", "o_custkey"),
              F.col("l_orderkey") == F.col("o_orderkey"))
    )
    keys = ("l_orderkey", "l_linenumber", "o_custkey")
    return lines.groupBy(*keys).agg(*_expressions("treatments")).drop(*keys)


class ClinicalViews(Mapping):
    """The nine tables by name, each built when first asked for.

    Treatments are joined and grouped from the largest tables, and three more tables are made of them: they are written
    to the shared folder once and read from there. A streaming ``events`` gives streaming labs and adverse events.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, events: DataFrame | None = None):
        self._spark, self._dir, self._events = spark, sf_dir, events
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name == "treatments":
                self._built[name] = self._written(_treatments(self.base))
                release_shuffles(self._spark)
            else:
                self._built[name] = getattr(self, f"_from_{name}")().select(*_expressions(name))
        return self._built[name]

    def __iter__(self):
        return iter(COLUMNS)

    def __len__(self) -> int:
        return len(COLUMNS)

    def base(self, name: str) -> DataFrame:
        if name == "events" and self._events is not None:
            return self._events
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")

    def _written(self, df: DataFrame) -> DataFrame:
        folder = shared_folder(self._spark)
        df.write.mode("overwrite").parquet(folder)
        return self._spark.read.schema(df.schema).parquet(folder)

    def _from_patients(self) -> DataFrame:
        return self.base("customer")

    def _from_providers(self) -> DataFrame:
        return self.base("supplier").join(self.base("nation").select("n_nationkey", "n_name"),
                                          F.col("s_nationkey") == F.col("n_nationkey"))

    def _from_encounters(self) -> DataFrame:
        return self.base("orders").withColumn("n_sup", self.base("supplier").agg(F.count("*")).scalar())

    def _from_diagnoses(self) -> DataFrame:
        second = F.expr("case when o_orderkey % 3 = 0 then array(0, 1) else array(0) end")
        return self.base("orders").withColumn("k", F.explode(second))

    def _from_medications(self) -> DataFrame:
        return self["treatments"].filter("treatment_id % 2 = 0")

    def _from_treatment_outcomes(self) -> DataFrame:
        return (self["treatments"].filter("treatment_id % 3 <> 0")
                .withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))))

    def _from_adverse_events(self) -> DataFrame:
        """Every event goes to the first treatment of an encounter among the first tenth."""
        tenth = self.base("orders").agg(F.floor(F.count("*") / 10).cast("bigint")).scalar()
        # every event's encounter is below that number, so only those are moved
        reached = self["treatments"].withColumn("n10", tenth).filter("encounter_id < n10 and encounter_id > -n10")
        first = reached.groupBy("encounter_id").agg(
            *[F.min(c).alias(c) for c in ("treatment_id", "patient_id", "start_date")])
        return (self.base("events").withColumn("n10", tenth)
                .withColumn("encounter_id", F.expr("(event_id * 7919) % n10"))
                .join(first, "encounter_id"))

    def _from_lab_results(self) -> DataFrame:
        return self.base("events")


def clinical_views(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> ClinicalViews:
    return ClinicalViews(spark, sf_dir, events)
