"""The SQL twin of every query, for an independent database over the same Parquet tables.

Written straight from what each report means, joins multiplied out where the report's definition
multiplies them; none of the rewrites of the Spark operators appear here.
"""

from __future__ import annotations

import re

from carestrata.operators.profile import TABS
from carestrata.plans.catalog import STORED, SUBMISSIONS
from carestrata.schema import AGE_BANDS, COHORT_AGE_BANDS, TABLES
from carestrata.sources.retail_mapping import AS_OF, COLUMNS, LABS_AS_OF
from carestrata.sources.tables import ID_COLUMNS

_FROM = {
    "patients": "customer",
    "providers": "supplier join nation on s_nationkey = n_nationkey",
    "encounters": "orders cross join (select count(*) as n_sup from supplier) s",
    "diagnoses": "orders cross join (select 0 as k union all select 1 as k) kk where k = 0 or o_orderkey % 3 = 0",
    "treatments": "lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey"
                  " group by l_orderkey, l_linenumber, o_custkey",
    "medications": "treatments where treatment_id % 2 = 0",
    "treatment_outcomes": "treatments cross join (select 1 as k union all select 2 as k) kk"
                          " where treatment_id % 3 <> 0",
    "adverse_events": "(select e.*, (event_id * 7919) % n10 as enc from events e cross join"
                      " (select cast(floor(count(*) / 10) as bigint) as n10 from orders) c) ev"
                      " join (select encounter_id, min(treatment_id) as treatment_id,"
                      " min(patient_id) as patient_id, min(start_date) as start_date"
                      " from treatments group by encounter_id) t on t.encounter_id = ev.enc",
    "lab_results": "events",
}
_NEEDS = {"medications": ["treatments"], "treatment_outcomes": ["treatments"],
          "adverse_events": ["treatments"]}


def _view(name: str) -> str:
    columns = ", ".join(f"{e.replace('TS', 'timestamp')} as {c}" for c, e in COLUMNS[name].items())
    return f"{name} as (select {columns} from {_FROM[name]})"


def _twin(sql: str) -> str:
    """Put the tables a query mentions in front of it."""
    used = {n for n in COLUMNS if re.search(rf"\b{n}\b", sql)}
    used |= {dep for n in used for dep in _NEEDS.get(n, [])}
    views = ",\n".join(_view(n) for n in COLUMNS if n in used)
    body = sql.strip()
    if body.startswith("with "):
        return f"with {views},\n{body[5:]}"
    return f"with {views}\n{body}"


# --- exact arithmetic: half-up division in integers, no floating point before the last step -----

def _half_up(num: str, den: str, scale: int) -> str:
    """num / den for integers, num >= 0, rounded half up to the scale."""
    return (f"(case when ({den}) > 0 then cast((2 * {scale} * cast({num} as hugeint) + ({den}))"
            f" // (2 * cast({den} as hugeint)) as double) / {scale} end)")


def _pct(num: str, den: str) -> str:
    return _half_up(f"(100 * cast({num} as hugeint))", den, 10)


def _avg2(column: str, weight: str = "1") -> str:
    cents = f"sum(cast({column} * 100 as hugeint) * {weight})"
    n = f"sum(case when {column} is not null then {weight} else 0 end)"
    return (f"(case when {n} > 0 then cast((2 * {cents} + {n}) // (2 * {n}) as double) / 100 end)")


_CHANGE = ("(case when baseline_value <> 0 then sign(result_value - baseline_value)"
           " * cast((2000 * abs(cast((result_value - baseline_value) * 100 as hugeint))"
           " + cast(baseline_value * 100 as hugeint))"
           " // (2 * cast(baseline_value * 100 as hugeint)) as double) / 10 end)")
_NAME = "first_name || ' ' || last_name"
_PNAME = "p.first_name || ' ' || p.last_name"
_AGE = f"cast(extract(year from age(date '{AS_OF}', date_of_birth)) as int)"


def _band(bands: list) -> str:
    """The label of an age: the first band whose exclusive upper age is above it, else the open one."""
    closed = " ".join(f"when {_AGE} < {top} then '{label}'" for top, label in bands if top is not None)
    return f"case {closed} else '{bands[-1][1]}' end"


_BAND, _COHORT_BAND = _band(AGE_BANDS), _band(COHORT_AGE_BANDS)
_UTC = "strftime({}, '%Y-%m-%d %H:%M:%S') || '+00'"


def _count_by(table: str, column: str, name: str = "count", where: str = "true") -> str:
    return f"select {column}, count(*) as {name} from {table} where {where} group by {column}"


def _search(term: str) -> str:
    return " or ".join(f"{c} ilike '%{term}%'" for c in ("first_name", "last_name", "mrn"))


# --- dashboards ---------------------------------------------------------------------------------

def _scorecard(treatments: str = "treatments") -> str:
    return f"""select treatment_name, treatment_type, count(distinct t.patient_id) as unique_patients,
      count(distinct outcome_id) filter (outcome_type = 'improvement') as improved,
      count(distinct outcome_id) filter (outcome_type = 'stable') as stable,
      count(distinct outcome_id) filter (outcome_type = 'progression') as progression,
      {_pct("count(distinct outcome_id) filter (outcome_type = 'improvement')", "count(distinct outcome_id)")} as improvement_rate_pct,
      count(distinct event_id) as adverse_event_count,
      count(distinct event_id) filter (severity in ('severe', 'life-threatening')) as serious_ae_count
    from {treatments} t left join treatment_outcomes o using (treatment_id)
      left join adverse_events a using (treatment_id)
    group by treatment_name, treatment_type"""


_DASHBOARD = {
    "age_distribution": f"select {_BAND} as age_group, count(*) as patient_count from patients"
                        " where is_active group by 1",
    "gender_distribution": _count_by("patients", "gender", "patient_count", "is_active"),
    "insurance_mix": _count_by("patients", "insurance_type", "patient_count", "is_active"),
    "efficacy_scorecard": _scorecard(),
    "outcome_trends": f"""select {_PNAME} as patient_name, treatment_name, outcome_measure,
      assessment_date, baseline_value, result_value, unit, {_CHANGE} as pct_change
      from treatment_outcomes o join patients p on p.patient_id = o.patient_id
      join treatments t on t.treatment_id = o.treatment_id""",
    "ae_monitor": f"""select treatment_name, event_type, severity, ctcae_grade, count(*) as event_count,
      {_half_up("sum(date_diff('day', onset_date, resolution_date))", "count(resolution_date)", 10)} as avg_duration_days
      from treatments join adverse_events using (treatment_id)
      group by treatment_name, event_type, severity, ctcae_grade""",
    "ae_by_severity": _count_by("adverse_events", "severity", "event_count"),
    "provider_activity": """select any_value(first_name || ' ' || last_name) as provider_name,
      any_value(specialty) as specialty, any_value(department) as department,
      count(distinct encounter_id) as encounter_count,
      count(distinct e.patient_id) as unique_patients,
      (select count(*) from treatments t where t.provider_id = v.provider_id) as treatments_ordered
      from providers v left join encounters e on e.provider_id = v.provider_id
      group by v.provider_id""",
    "diagnosis_cohorts": f"""select icd10_code, description as diagnosis_description, gender,
      {_COHORT_BAND} as age_group, count(*) as patient_count
      from patients join diagnoses using (patient_id) where status = 'active' group by all""",
    "diagnosis_cohorts_unique": f"""select icd10_code, description as diagnosis_description, gender,
      {_COHORT_BAND} as age_group, count(*) as patient_count,
      count(distinct patient_id) as unique_patients
      from patients join diagnoses using (patient_id) where status = 'active'
      group by 1, 2, 3, 4""",
    "abnormal_labs": f"""select {_NAME} as patient_name, test_name, collected_date, result_value, unit,
      reference_low, reference_high, abnormal_flag
      from lab_results join patients using (patient_id) where abnormal_flag <> 'N'
      order by collected_date desc, lab_id limit 200""",
    "kpi_cards": """select unnest(['Total Patients', 'Active Treatments', 'Total Encounters',
        'Adverse Events', 'Severe AEs (≥ G3)']) as metric,
      unnest([cast((select count(*) from patients where is_active) as varchar),
        cast((select count(*) from treatments where status = 'active') as varchar),
        cast((select count(*) from encounters) as varchar),
        cast((select count(*) from adverse_events) as varchar),
        cast((select count(*) from adverse_events where ctcae_grade >= 3) as varchar)]) as value""",
    "cancer_treatment_outcomes": """select description as diagnosis, treatment_name, outcome_type,
      count(distinct patient_id) as patient_count
      from diagnoses join treatments using (patient_id)
      left join (select treatment_id, outcome_type from treatment_outcomes) o
        on o.treatment_id = treatments.treatment_id
      where starts_with(icd10_code, 'C') group by all""",
}

# --- overview -----------------------------------------------------------------------------------

_OVERVIEW = {
    "headline_counts": """select 'Active Patients' as metric, count(*) as value from patients where is_active
      union all select 'Active Providers', count(*) from providers where is_active
      union all select 'Total Encounters', count(*) from encounters
      union all select 'Treatments', count(*) from treatments
      union all select 'Adverse Events', count(*) from adverse_events""",
    "encounters_by_type": _count_by("encounters", "encounter_type"),
    "diagnoses_by_status": _count_by("diagnoses", "status"),
    "patients_by_insurance": _count_by("patients", "insurance_type", where="is_active"),
    "treatments_by_type": _count_by("treatments", "treatment_type"),
    "recent_encounters": f"""select encounter_id, mrn, {_PNAME} as patient_name,
      v.first_name || ' ' || v.last_name as provider_name, encounter_type, admission_date, disposition
      from encounters e join patients p using (patient_id) join providers v using (provider_id)
      order by admission_date desc, encounter_id limit 20""",
}

# --- patient 360 --------------------------------------------------------------------------------

_ENCOUNTERS = f"""select patient_id, encounter_id, encounter_type, admission_date, discharge_date,
  disposition, {_NAME} as provider, specialty
  from encounters join providers using (provider_id)"""
_TREATED = """select t.patient_id, t.treatment_id, treatment_name, treatment_type, status, start_date,
  end_date, dosage, frequency, outcome_id, outcome_type, outcome_measure, baseline_value, result_value,
  unit from treatments t left join treatment_outcomes o on o.treatment_id = t.treatment_id"""


def _tab(tab: str, table: str, day: str, key: str) -> str:
    return (f"select patient_id, '{tab}' as tab, (row_number() over (partition by patient_id order by"
            f" cast({day} as date) desc, {key}) - 1) // 50 as page from {table}")


_TABS = [
    ("encounters", "encounters", "admission_date", "cast(encounter_id as varchar)"),
    ("diagnoses", "diagnoses", "diagnosed_date", "cast(diagnosis_id as varchar)"),
    ("treatments", f"({_TREATED}) x", "start_date",
     "concat_ws('/', cast(treatment_id as varchar), cast(outcome_id as varchar))"),
    ("medications", "medications", "prescribed_date", "cast(medication_id as varchar)"),
    ("lab_results", "lab_results", "collected_date", "cast(lab_id as varchar)"),
    ("adverse_events", "adverse_events", "onset_date", "cast(event_id as varchar)"),
]
_TAB_COUNTS = ", ".join(f"count(*) filter (tab = '{t[0]}') as {t[0]}" for t in _TABS)

_PATIENT = {
    "search_patients": f"""select patient_id, mrn, {_NAME} as patient_name, date_of_birth, gender,
      insurance_type from patients where is_active and ({_search('p0000001_3')})
      order by last_name, first_name, mrn limit 50""",
    "demographics": f"""select patient_id, mrn, first_name, last_name, date_of_birth, gender, race,
      ethnicity, insurance_type, zip_code, {_AGE} as age from patients""",
    "encounter_history": _ENCOUNTERS,
    "encounter_history_one": f"{_ENCOUNTERS} where patient_id = 7",
    "diagnosis_history": """select patient_id, diagnosis_id, icd10_code, description, status,
      diagnosed_date, resolved_date from diagnoses""",
    "treatment_history": _TREATED,
    "treatment_history_by_name": f"""{_TREATED} where t.patient_id in
      (select patient_id from patients where {_NAME} = 'Ana P000000005')""",
    "medication_history": """select patient_id, medication_id, drug_name, generic_name,
      cast(null as varchar) as ndc_code, dosage_form, strength, quantity, refills_remaining,
      prescribed_date from medications""",
    "lab_history": """select patient_id, lab_id, test_name, loinc_code, result_value, unit,
      reference_low, reference_high, abnormal_flag, collected_date from lab_results""",
    "ae_history": """select a.patient_id, event_id, event_type, severity, ctcae_grade, onset_date,
      resolution_date, action_taken, outcome, treatment_name
      from adverse_events a join treatments using (treatment_id)""",
    "patient_profile_sizes": f"""with rows as (
        {' union all '.join(_tab(*t) for t in _TABS)}
        union all select patient_id, 'person', 0 from patients)
      select r.patient_id, cast(page as int) as page, case when page = 0 then any_value(mrn) end as mrn,
      case when page = 0 then any_value({_AGE}) end as age, {_TAB_COUNTS}
      from rows r join patients p on p.patient_id = r.patient_id group by r.patient_id, page""",
    "patient_profile_labs": """with numbered as (
        select *, row_number() over (partition by patient_id order by cast(collected_date as date) desc nulls last,
          md5(cast(lab_id as varchar)), cast(lab_id as varchar)) - 1 as i from lab_results)
      select patient_id, cast(i // 50 as int) as page, cast(i % 50 as int) as at, test_name,
      result_value, collected_date from numbered""",
}


def _profile_tab(tab: str, source: str, day: str, key: str) -> str:
    """Every field of one tab with its page and place: newest day first, then by digest of the key."""
    return f"""with numbered as (select *, row_number() over (partition by patient_id order by
        cast({day} as date) desc nulls last, md5({key}), {key}) - 1 as i from ({source}) x)
      select patient_id, cast(i // 50 as int) as page, cast(i % 50 as int) as at, {', '.join(TABS[tab][2])}
      from numbered"""


_SHOWN = {"encounters": "encounter_history", "treatments": "treatment_history", "medications": "medication_history",
          "adverse_events": "ae_history"}
_PATIENT |= {f"patient_profile_{tab}": _profile_tab(
    tab, _PATIENT[_SHOWN[tab]] if tab in _SHOWN else f"select * from {tab}", day, key) for tab, _, day, key in _TABS}
_PATIENT["patient_profile_people"] = _PATIENT["demographics"]

# --- treatment analytics ------------------------------------------------------------------------

_MED = "treatment_type = 'medication' and status = 'active'"


def _kpis(where: str) -> str:
    improved = "count(distinct outcome_id) filter (outcome_type = 'improvement')"
    return f"""select count(distinct t.treatment_id) as total_treatments,
      count(distinct t.patient_id) as unique_patients, {improved} as improved,
      count(distinct outcome_id) as total_outcomes,
      coalesce({_pct(improved, 'count(distinct outcome_id)')}, 0) as improvement_rate_pct
      from treatments t left join treatment_outcomes o on t.treatment_id = o.treatment_id
      where {where}"""


def _distribution(where: str) -> str:
    return f"""select treatment_name, outcome_type, count(*) as count
      from treatment_outcomes join treatments using (treatment_id)
      where {where} group by treatment_name, outcome_type"""


def _averages(where: str) -> str:
    return f"""select treatment_name, {_avg2('baseline_value')} as avg_baseline,
      {_avg2('result_value')} as avg_result
      from treatment_outcomes join treatments using (treatment_id)
      where {where} group by treatment_name having count(*) >= 2"""


def _detail(where: str) -> str:
    return f"""select treatment_name, treatment_type, status, count(distinct t.patient_id) as patients,
      count(distinct outcome_id) as outcomes, count(distinct event_id) as adverse_events,
      {_avg2('baseline_value')} as avg_baseline, {_avg2('result_value')} as avg_result
      from treatments t left join treatment_outcomes o on o.treatment_id = t.treatment_id
      left join adverse_events a on a.treatment_id = t.treatment_id
      where {where} group by treatment_name, treatment_type, status"""


_TREATMENT = {
    "treatment_kpis": _kpis("true"),
    "treatment_kpis_faceted": _kpis(_MED),
    "outcome_distribution": _distribution("true"),
    "outcome_distribution_faceted": _distribution(_MED),
    "baseline_vs_result": _averages("true"),
    "baseline_vs_result_faceted": _averages(_MED),
    "baseline_vs_result_long": f"""with wide as ({_averages('true')})
      select treatment_name, 'avg_baseline' as "Metric", avg_baseline as "Value" from wide
      union all select treatment_name, 'avg_result', avg_result from wide""",
    "treatment_detail": _detail("true"),
    "treatment_detail_faceted": _detail(_MED),
    "treatment_detail_corrected": f"""with once as (
        select treatment_name, treatment_type, status, {_avg2('baseline_value')} as avg_baseline,
        {_avg2('result_value')} as avg_result
        from treatments t left join treatment_outcomes o on o.treatment_id = t.treatment_id
        group by treatment_name, treatment_type, status),
      counts as ({_detail('true')})
      select c.* exclude (avg_baseline, avg_result), o.avg_baseline, o.avg_result
      from counts c join once o using (treatment_name, treatment_type, status)""",
}

# --- adverse events -----------------------------------------------------------------------------

_OPEN = "severity = 'severe' and resolution_date is null"
_AE_COLUMNS = f"""event_id, mrn, {_PNAME} as patient_name, treatment_name, event_type, severity,
  ctcae_grade, onset_date, resolution_date, action_taken, outcome"""
_AE_JOINED = """adverse_events a join patients p on p.patient_id = a.patient_id
  join treatments t on t.treatment_id = a.treatment_id"""


def _ae_top(where: str) -> str:
    return f"""select treatment_name, count(*) as count from adverse_events
      join treatments using (treatment_id) where {where} group by treatment_name
      order by count desc, treatment_name limit 15"""


_SAFETY = {
    "ae_kpis": """select count(*) as total_events, count(distinct patient_id) as affected_patients,
      count(*) filter (severity in ('severe', 'life-threatening')) as serious_count,
      count(*) - count(resolution_date) as unresolved from adverse_events""",
    "ae_severity_ranked": _count_by("adverse_events", "severity"),
    "ae_severity_ranked_faceted": _count_by("adverse_events", "severity", where="event_type = 'Nausea'"),
    "ae_top_treatments": _ae_top("true"),
    "ae_top_treatments_faceted": _ae_top(_OPEN),
    "ae_grade_distribution": _count_by("adverse_events", "ctcae_grade, event_type"),
    "ae_grade_distribution_faceted": _count_by("adverse_events", "ctcae_grade, event_type", where=_OPEN),
    "ae_detail": f"""select {_AE_COLUMNS} from {_AE_JOINED}
      order by onset_date desc, event_id limit 100""",
    "ae_detail_faceted": f"""select {_AE_COLUMNS} from {_AE_JOINED} where {_OPEN}
      order by onset_date desc, event_id limit 100""",
}

# --- labs ---------------------------------------------------------------------------------------

_FLAG = ("coalesce(map {'N': 'Normal', 'H': 'High', 'L': 'Low', 'HH': 'Critical High',"
         " 'LL': 'Critical Low'}[abnormal_flag], abnormal_flag)")
_LAB = "result_value, unit, reference_low, reference_high, abnormal_flag"


def _lab_detail(where: str) -> str:
    return f"""select mrn, {_NAME} as patient_name, test_name, loinc_code, {_LAB}, collected_date
      from lab_results join patients using (patient_id) where {where}
      order by collected_date desc, lab_id limit 100"""


_LABS = {
    "lab_kpis": """select count(*) as total_results, count(distinct patient_id) as patients_tested,
      count(distinct test_name) as unique_tests,
      count(*) filter (abnormal_flag <> 'N') as abnormal_count from lab_results""",
    "lab_flag_distribution": f"select {_FLAG} as flag_label, count(*) as count from lab_results group by 1",
    "lab_flag_distribution_faceted": f"""select {_FLAG} as flag_label, count(*) as count
      from lab_results where test_name = 'HbA1c' group by 1""",
    "top_abnormal_tests": f"""with flagged as (select test_name, abnormal_flag <> 'N' as bad from lab_results)
      select test_name, count(*) filter (bad) as abnormal, count(*) as total,
      {_pct('count(*) filter (bad)', 'count(*)')} as abnormal_pct from flagged
      group by test_name having bool_or(bad) order by abnormal desc, test_name limit 10""",
    "patients_with_labs": f"""select patient_id, mrn, {_NAME} as name from patients
      where ({_search('EVA')}) and patient_id in (select patient_id from lab_results)
      order by mrn limit 20""",
    "lab_detail": _lab_detail("true"),
    "lab_detail_faceted": _lab_detail("test_name = 'HbA1c' and abnormal_flag = 'H'"),
    "lab_trends": f"""select patient_id, test_name, lab_id, collected_date, {_LAB},
      lag(result_value) over series as previous_value,
      result_value - lag(result_value) over series as delta from lab_results
      window series as (partition by patient_id, test_name order by collected_date, lab_id)""",
    "lab_series": """with ordered as (select *, row_number() over (partition by patient_id, test_name
        order by collected_date, lab_id) as i, date_diff('day', date '1970-01-01',
        cast(collected_date as date)) as day from lab_results),
      moments as (select patient_id, test_name,
        count(*) * sum(day * day) - sum(day) * sum(day) as sxx,
        count(*) * sum(day * units) - sum(day) * sum(units) as sxy
        from (select patient_id, test_name, cast(day as hugeint) as day,
          cast(result_value * 10000 as hugeint) as units from ordered) group by patient_id, test_name)
      select patient_id, test_name, count(*) as points, count(*) filter (abnormal_flag <> 'N') as abnormal,
      min(collected_date) as first_collected, max(collected_date) as last_collected,
      arg_min(result_value, i) as first_value, arg_max(result_value, i) as last_value,
      case when sxx > 0 then sign(sxy) * cast((2000000 * abs(sxy) + 10000 * sxx) // (20000 * sxx) as double)
        / 1000000 end as slope_per_day,
      arg_min(reference_low, i) filter (reference_low is not null) as band_low,
      arg_min(reference_high, i) filter (reference_high is not null) as band_high,
      arg_max(result_value, i) - arg_min(result_value, i) as change
      from ordered join moments using (patient_id, test_name) group by patient_id, test_name, sxx, sxy""",
}

# --- pickers ------------------------------------------------------------------------------------

_PICKERS = {
    "treatment_type_choices": "select distinct treatment_type from treatments",
    "event_type_choices": "select distinct event_type from adverse_events",
    "test_choices": "select distinct test_name from lab_results",
    "test_choices_one_patient": "select distinct test_name from lab_results where patient_id = 7",
    "active_patients": f"select patient_id, mrn, {_NAME} as name from patients where is_active",
    "active_providers": f"select provider_id, {_NAME} as name, specialty from providers where is_active",
    "encounter_choices": f"""select encounter_id, patient_id, provider_id, mrn, {_NAME} as patient_name,
      encounter_type, {_UTC.format('admission_date')} as adm
      from encounters join patients using (patient_id)
      order by admission_date desc, encounter_id limit 50""",
    "active_treatment_choices": f"""select treatment_id, patient_id, treatment_name, mrn,
      {_NAME} as patient_name from treatments join patients using (patient_id)
      where status = 'active' order by start_date desc, treatment_id limit 50""",
    "latest_patients": f"""select mrn, {_NAME} as name, gender, insurance_type, created_at from patients
      order by created_at desc, mrn limit 5""",
    "latest_encounters": f"""select mrn, {_PNAME} as patient_name, encounter_type, admission_date,
      e.created_at from encounters e join patients p using (patient_id)
      order by e.created_at desc, encounter_id limit 5""",
}

# --- graph --------------------------------------------------------------------------------------

_NODES = f"""select 'patient:' || patient_id as node_id, 'patient' as kind,
    'Patient: ' || {_NAME} as label, patient_id, '#3498db' as color, 30 as size, 1 as ordinal from patients
  union all select 'encounter:' || encounter_id, 'encounter', 'Enc: ' || encounter_type || chr(10)
    || {_UTC.format('admission_date')}, patient_id, '#2ecc71', 18, 2 from encounters
  union all select 'diagnosis:' || diagnosis_id, 'diagnosis', 'Dx: ' || icd10_code || chr(10)
    || substr(description, 1, 30), patient_id, '#9b59b6', 18, 3 from diagnoses
  union all select 'treatment:' || treatment_id, 'treatment', 'Tx: ' || treatment_name, patient_id,
    '#e67e22', 20, 4 from treatments
  union all select 'outcome:' || outcome_id, 'outcome', 'Out: ' || outcome_type || chr(10)
    || substr(coalesce(outcome_measure, ''), 1, 25), patient_id, '#1abc9c', 14, 5 from treatment_outcomes
  union all select 'adverse_event:' || event_id, 'adverse_event', 'AE: ' || event_type || chr(10)
    || '(' || severity || ')', patient_id, '#e74c3c', 16, 6 from adverse_events"""


def _leaf(select: str, table: str) -> str:
    return f"""select {select} from {table} c join treatments t
      on t.treatment_id = c.treatment_id and t.patient_id = c.patient_id"""


_GRAPH = {
    "graph_nodes": f"select * exclude (ordinal) from ({_NODES})",
    "graph_edges": f"""select 'patient:' || patient_id as src, 'encounter:' || encounter_id as dst,
        'patient-encounter' as kind, patient_id from encounters
      union all select 'patient:' || patient_id, 'diagnosis:' || diagnosis_id, 'patient-diagnosis',
        patient_id from diagnoses
      union all select 'patient:' || patient_id, 'treatment:' || treatment_id, 'patient-treatment',
        patient_id from treatments
      union all {_leaf("'treatment:' || c.treatment_id, 'outcome:' || outcome_id, 'treatment-outcome', c.patient_id", 'treatment_outcomes')}
      union all {_leaf("'treatment:' || c.treatment_id, 'adverse_event:' || event_id, 'treatment-adverse_event', c.patient_id", 'adverse_events')}""",
    "graph_summary": """select *, encounters + diagnoses + treatments + treatment_outcomes + adverse_events > 0
        as has_data from (select patient_id,
        (select count(*) from encounters x where x.patient_id = p.patient_id) as encounters,
        (select count(*) from diagnoses x where x.patient_id = p.patient_id) as diagnoses,
        (select count(*) from treatments x where x.patient_id = p.patient_id) as treatments,
        (select count(*) from treatment_outcomes x where x.patient_id = p.patient_id) as treatment_outcomes,
        (select count(*) from adverse_events x where x.patient_id = p.patient_id) as adverse_events
      from patients p)""",
    "graph_layout": f"""with placed as (select patient_id, node_id,
        row_number() over (partition by patient_id order by ordinal, md5(node_id), node_id) - 1 as i,
        count(*) over (partition by patient_id) as n from ({_NODES}))
      select patient_id, node_id, i, n,
      case when i = 0 then 0.0::double else round((2 + (i % 3) * 0.5::double) * cos(2 * pi() * (i - 1) / (n - 1)), 6) + 0.0::double end as x,
      case when i = 0 then 0.0::double else round((2 + (i % 3) * 0.5::double) * sin(2 * pi() * (i - 1) / (n - 1)), 6) + 0.0::double end as y
      from placed""",
    "graph_paths": f"""{_leaf("c.patient_id, 'patient:' || c.patient_id as patient_node, 'treatment:' || c.treatment_id as treatment_node, 'outcome:' || outcome_id as leaf_node, 'outcome' as leaf_kind", 'treatment_outcomes')}
      union all {_leaf("c.patient_id, 'patient:' || c.patient_id, 'treatment:' || c.treatment_id, 'adverse_event:' || event_id, 'adverse_event'", 'adverse_events')}""",
    "graph_collapsed": f"""select patient_id, label, min(kind) as kind, min(node_id) as node_id,
      count(*) as copies from ({_NODES}) group by patient_id, label""",
    "graph_patient_choices": f"""select patient_id, mrn, {_NAME} as patient_name, date_of_birth, gender,
      insurance_type from patients where is_active and ({_search('chi')})
      order by last_name, first_name, mrn limit 20""",
}

# --- questions ----------------------------------------------------------------------------------

_MEDS = """mrn, medication_id, drug_name, generic_name, cast(null as varchar) as ndc_code, dosage_form,
  m.strength, quantity, refills_remaining, prescribed_date"""


def _current(where: str) -> str:
    return f"""select {_MEDS} from medications m join patients p on p.patient_id = m.patient_id
      left join treatments t on t.treatment_id = m.treatment_id
      where (coalesce(t.status = 'active', false) or refills_remaining > 0) and {where}"""


def _trend(where: str) -> str:
    return f"""with recent as (select * from lab_results where test_name = 'HbA1c'
        and collected_date >= date '{LABS_AS_OF}' - interval 6 month
        and collected_date < date '{LABS_AS_OF}' + interval 1 day)
      select mrn, test_name, lab_id, collected_date, result_value, unit,
      result_value - lag(result_value) over (partition by r.patient_id order by collected_date, lab_id) as delta
      from recent r join patients p on p.patient_id = r.patient_id where {where}"""


def _side(part: str) -> str:
    chosen = f"(select * from treatments where treatment_name ilike '%{part}%')"
    outcomes = f"(select o.* from treatment_outcomes o semi join {chosen} c on c.treatment_id = o.treatment_id)"
    events = f"(select a.* from adverse_events a semi join {chosen} c on c.treatment_id = a.treatment_id)"
    patients = f"(select count(distinct patient_id) from {chosen})"
    n_events = f"(select count(*) from {events})"
    return f"""select unnest(['patients', 'treatments', 'outcomes', 'events', 'serious_events',
        'improvement_rate_pct', 'events_per_patient']) as metric,
      unnest([cast({patients} as double), (select count(*) from {chosen}),
        (select count(*) from {outcomes}), {n_events},
        (select count(*) from {events} where severity in ('severe', 'life-threatening')),
        (select {_pct("count(*) filter (outcome_type = 'improvement')", 'count(*)')} from {outcomes}),
        {_half_up(n_events, patients, 10000)}]) as v"""


def _ranking(cohort: str) -> str:
    return f"""with chosen as (select * from treatments where {cohort}),
      card as ({_scorecard('chosen')})
      select *, rank() over (order by improvement_rate_pct desc nulls last) as rank from card"""


def _success(serious: str) -> str:
    return f"""with t as (select
        treatment_id in (select treatment_id from treatment_outcomes where outcome_type = 'improvement') as good,
        treatment_id in (select treatment_id from adverse_events where {serious}) as bad from treatments)
      select count(*) as treatments, count(*) filter (good) as with_improvement,
      count(*) filter (bad) as with_serious_ae,
      {_pct('count(*) filter (good)', 'count(*)')} as improvement_pct,
      {_pct('count(*) filter (bad)', 'count(*)')} as serious_ae_pct from t"""


_SINCE = f"date '{AS_OF}'"
_DAYS = f"date_diff('day', start_date, coalesce(end_date, {_SINCE}))"
_EVENT = "event_id, patient_id, treatment_id, event_type, severity, ctcae_grade, onset_date"
_MONTH = "(extract(year from {0}) * 12 + extract(month from {0}) - 1)"
_BEGIN, _END = _MONTH.format("start_date"), _MONTH.format(f"least(coalesce(end_date, {_SINCE}), {_SINCE})")

_QUESTIONS = {
    "current_medications": _current("true"),
    "current_medications_one": _current("mrn = 'MRN-000010'"),
    "breast_cancer_patients": f"""select patient_id, mrn, gender, date_of_birth, {_NAME} as patient_name
      from patients where patient_id in (select patient_id from diagnoses where icd10_code like 'C50%')""",
    "breast_cancer_under_treatment": """select count(*) as patients, count(*) filter (patient_id in
      (select patient_id from treatments where status = 'active')) as under_treatment
      from (select distinct patient_id from diagnoses where icd10_code like 'C50%')""",
    "hba1c_trend": _trend("true"),
    "hba1c_trend_one": _trend("mrn = 'MRN-000002'"),
    "events_of_treatment": f"""select {_EVENT} from adverse_events where treatment_id in
      (select treatment_id from treatments where treatment_name ilike '%red anvil%')""",
    "events_of_patients_on": f"""select {_EVENT} from adverse_events where patient_id in
      (select patient_id from treatments where treatment_name ilike '%red anvil%')""",
    "abnormal_labs_this_month": f"""select patient_id, mrn, {_NAME} as patient_name,
      count(*) as abnormal_results, count(*) filter (abnormal_flag in ('HH', 'LL')) as critical_results,
      max(collected_date) as latest from lab_results join patients using (patient_id)
      where abnormal_flag <> 'N' and strftime(collected_date, '%Y-%m') = '{LABS_AS_OF[:7]}'
      group by all""",
    "compare_treatments": f"""with a as ({_side('anvil')}), b as ({_side('bolt')})
      select metric, a.v as first, b.v as second, round(a.v - b.v, 4) as difference
      from a join b using (metric)""",
    "recist_response": f"""with who as (select d.patient_id from diagnoses d join encounters e
        on e.encounter_id = d.encounter_id where icd10_code like 'C%'
        and lower(chief_complaint) like '%stage iii%'),
      m as (select treatment_id, patient_id, {_CHANGE} as pct from treatment_outcomes
        where outcome_measure like 'RECIST%' and baseline_value <> 0
        and patient_id in (select patient_id from who))
      select treatment_name, count(distinct m.patient_id) as patients, count(*) as assessments,
      count(*) filter (pct <= -30) as responses, min(pct) as best_change_pct,
      {_pct('count(*) filter (pct <= -30)', 'count(*)')} as response_rate_pct
      from m join treatments t on t.treatment_id = m.treatment_id group by treatment_name""",
    "dose_reduction_outcomes": """with r as (select treatment_id, count(*) as dose_reductions,
        min(onset_date) as first_reduction from adverse_events where action_taken ilike '%dose reduc%'
        group by treatment_id)
      select o.patient_id, o.treatment_id, treatment_name, dose_reductions, first_reduction, outcome_id,
      outcome_type, assessment_date
      from r join treatment_outcomes o on o.treatment_id = r.treatment_id
      join treatments t on t.treatment_id = o.treatment_id where assessment_date >= first_reduction""",
    "comorbid_overlaps": f"""with c as (select patient_id, treatment_id, treatment_name, start_date,
        greatest(coalesce(end_date, {_SINCE}), start_date) as until from treatments
        where patient_id in (select patient_id from diagnoses where icd10_code like 'E11%')
        and patient_id in (select patient_id from diagnoses where icd10_code like 'C%')),
      marked as (select *, coalesce(start_date > max(until) over (partition by patient_id
        order by start_date, treatment_id rows between unbounded preceding and 1 preceding), true) as fresh from c),
      numbered as (select *, sum(fresh::int) over (partition by patient_id order by start_date, treatment_id)
        as episode from marked),
      counted as (select a.treatment_id, count(*) as overlapping from c a join c b
        on b.patient_id = a.patient_id and b.treatment_id <> a.treatment_id
        and b.start_date <= a.until and b.until >= a.start_date group by a.treatment_id)
      select patient_id, treatment_id, treatment_name, start_date, until,
      cast(episode as bigint) as episode, overlapping from numbered join counted using (treatment_id)""",
    "time_to_treatment": """with f as (select patient_id, min(diagnosed_date) as diagnosed from diagnoses
        where icd10_code like 'C50%' group by patient_id)
      select f.patient_id, diagnosed, min(start_date) as first_treatment,
      cast(date_diff('day', diagnosed, min(start_date)) as int) as days_to_treatment
      from f join treatments t on t.patient_id = f.patient_id and start_date >= diagnosed
      group by f.patient_id, diagnosed""",
    "mean_time_to_treatment": f"""with f as (select patient_id, min(diagnosed_date) as diagnosed
        from diagnoses where icd10_code like 'C50%' group by patient_id),
      w as (select f.patient_id, date_diff('day', diagnosed, min(start_date)) as d
        from f join treatments t on t.patient_id = f.patient_id and start_date >= diagnosed
        group by f.patient_id, diagnosed)
      select count(*) as patients, {_half_up('sum(d)', 'count(*)', 10)} as avg_days from w""",
    "population_breakdown": f"""select {_BAND} as age_group, insurance_type, count(*) as patient_count,
      cast(grouping({_BAND}) as int) as all_ages, cast(grouping(insurance_type) as int) as all_insurance
      from patients where is_active group by cube ({_BAND}, insurance_type)""",
    "zip_ranking": """select zip_code, count(*) as patient_count, rank() over (order by count(*) desc) as rank
      from patients group by zip_code""",
    "cancer_gender_distribution": """select icd10_code, description, gender,
      count(distinct patient_id) as patients from diagnoses join patients using (patient_id)
      where icd10_code like 'C%' group by all""",
    "cohort_sizes": """select icd10_code, description, count(distinct patient_id) as patients,
      count(*) as diagnoses from diagnoses group by all""",
    "treatment_ranking": _ranking("true"),
    "treatment_ranking_cancer": _ranking(
        "patient_id in (select patient_id from diagnoses where icd10_code like 'C%')"),
    "serious_rate_above": f"""with t as (select treatment_name, treatment_id in (select treatment_id
        from adverse_events where severity in ('severe', 'life-threatening')) as bad from treatments)
      select treatment_name, count(*) as treatments, count(*) filter (bad) as with_serious_ae,
      {_pct('count(*) filter (bad)', 'count(*)')} as serious_rate_pct from t
      group by treatment_name having count(*) filter (bad) * 50 > count(*)""",
    "treatment_durations": f"""select treatment_type, count(*) as treatments,
      {_half_up(f'sum({_DAYS})', 'count(*)', 10)} as avg_days,
      count(*) filter (status = 'completed') as completed,
      {_half_up(f"sum({_DAYS}) filter (status = 'completed')", "count(*) filter (status = 'completed')", 10)} as avg_completed_days
      from treatments where start_date <= {_SINCE} group by treatment_type""",
    "treatment_mix": f"""with mix as (select treatment_type, count(distinct patient_id) as patients
        from treatments group by treatment_type)
      select treatment_type, patients, {_pct('patients', '(select sum(patients) from mix)')} as share_pct
      from mix""",
    "recent_high_grade": f"""select {_AE_COLUMNS} from {_AE_JOINED}
      where ctcae_grade >= 3 and onset_date between {_SINCE} - interval 365 day and {_SINCE}""",
    "ae_rate_per_patient": f"""select treatment_name, count(distinct t.patient_id) as patients,
      count(distinct event_id) as adverse_events,
      {_half_up('count(distinct event_id)', 'count(distinct t.patient_id)', 10000)} as events_per_patient
      from treatments t left join adverse_events a on a.treatment_id = t.treatment_id
      group by treatment_name""",
    "actions_for_severe": _count_by("adverse_events", "action_taken", "event_count", "severity = 'severe'"),
    "treatment_success": _success("severity in ('severe', 'life-threatening')"),
    "treatment_success_by_grade": _success("ctcae_grade >= 3"),
    "actively_treating": """select count(distinct provider_id) as providers, count(*) as active_treatments
      from treatments where status = 'active'""",
    "mean_event_rate": f"""with t as (select (select count(*) from adverse_events a
        where a.treatment_id = x.treatment_id) as n from treatments x)
      select count(*) as treatments, count(*) filter (n > 0) as with_events,
      cast(sum(n) as bigint) as adverse_events,
      {_half_up('sum(n)', 'count(*)', 10000)} as events_per_treatment from t""",
    "service_line_efficacy": f"""with l as (select *, case when specialty ilike '%oncology%' then 'oncology'
        when specialty ilike '%cardiology%' then 'cardiology'
        when specialty ilike '%endocrinology%' then 'endocrinology' end as service_line from providers)
      select service_line, count(distinct t.treatment_id) as treatments, count(outcome_id) as outcomes,
      count(*) filter (outcome_type = 'improvement') as improved,
      {_pct("count(*) filter (outcome_type = 'improvement')", 'count(outcome_id)')} as improvement_rate_pct
      from l join treatments t on t.provider_id = l.provider_id
      left join treatment_outcomes o on o.treatment_id = t.treatment_id
      where service_line is not null group by service_line""",
    "department_volume": """select department, count(*) as encounter_count
      from encounters join providers using (provider_id) group by department""",
    "specialty_workload": f"""with v as (select specialty, p.provider_id, count(encounter_id) as n
        from providers p left join encounters e on e.provider_id = p.provider_id group by all)
      select specialty, count(*) as providers, cast(sum(n) as bigint) as encounters,
      max(n) as busiest_provider, {_half_up('sum(n)', 'count(*)', 10)} as encounters_per_provider
      from v group by specialty""",
    "event_rate_trend": f"""with c as (select treatment_id, treatment_name, {_BEGIN} as b,
        greatest({_BEGIN}, {_END}) as e from treatments where start_date <= {_SINCE}),
      spread as (select treatment_name, unnest(range(b, e + 1)) as month from c),
      courses as (select treatment_name, month, count(*) as courses from spread group by all),
      ev as (select treatment_name, {_MONTH.format('onset_date')} as month, count(*) as n
        from adverse_events a join treatments t on t.treatment_id = a.treatment_id
        where onset_date <= {_SINCE} group by all),
      r as (select treatment_name, month, coalesce(n, 0) as n, coalesce(n, 0) / courses as rate
        from courses left join ev using (treatment_name, month))
      select treatment_name, count(*) as months, cast(sum(n) as bigint) as adverse_events,
      round(case when var_pop(month) > 0 then regr_slope(rate, month) end, 6) as rate_slope,
      round(case when var_pop(month) > 0 then regr_slope(rate, month) end, 6) > 0 as rising
      from r group by treatment_name""",
    "frequent_visitors": f"""select patient_id, mrn, {_NAME} as patient_name, count(*) as encounter_count,
      max(admission_date) as last_admission from encounters join patients using (patient_id)
      where admission_date >= {_SINCE} - interval 6 month and admission_date < {_SINCE} + interval 1 day
      group by all order by encounter_count desc, patient_id limit 20""",
    "readmission_rates": f"""with s as (select encounter_id, patient_id,
        cast(discharge_date as date) as left_on from encounters
        where encounter_type = 'inpatient' and discharge_date is not null),
      r as (select s.*, exists (select 1 from encounters n where n.patient_id = s.patient_id
        and n.encounter_type = 'inpatient' and n.encounter_id <> s.encounter_id
        and cast(n.admission_date as date) between left_on and left_on + 30) as back from s)
      select icd10_code, description, count(*) as stays, count(*) filter (back) as readmitted,
      {_pct('count(*) filter (back)', 'count(*)')} as readmission_rate_pct
      from (select distinct r.encounter_id, back, icd10_code, description from r
        join diagnoses d on d.encounter_id = r.encounter_id) group by all""",
    "older_patients_with_active_cancer": f"""select patient_id, mrn, {_NAME} as patient_name,
      {_AGE} as age, gender from patients where {_AGE} > 70 and patient_id in
      (select patient_id from diagnoses where status = 'active' and icd10_code like 'C%')""",
}
_QUESTIONS["providers_by_patients"] = _DASHBOARD["provider_activity"]


# --- record entry -------------------------------------------------------------------------------

def _batch(entity: str) -> str:
    source, columns = SUBMISSIONS[entity]
    return f"select {', '.join(f'{e} as {c}' for c, e in columns.items())} from {source}"


def _uuid(entity: str) -> str:
    h = f"md5('{entity}|' || submission_id)"
    parts = "||'-'||".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"({parts})"


_INGEST = {
    "ingest_patients": f"""with b as ({_batch('patients')}),
      j as (select *, case when trim(first_name) = '' then 'first_name is required'
        when date_of_birth not between date '1920-01-01' and {_SINCE} then 'date_of_birth out of range'
        when length(mrn) > 20 then 'mrn too long'
        when race = 'Unknown' then 'race not in list' end as broken from b)
      select submission_id, {_uuid('patients')} as patient_id, mrn,
      case when trim(first_name) <> '' then first_name end as first_name,
      case when trim(zip_code) <> '' then zip_code end as zip_code,
      'English' as primary_language, true as is_active,
      case when broken is not null then broken
        when mrn in (select mrn from patients) then 'mrn already in use'
        when submission_id > (select min(k.submission_id) from j k where k.mrn = j.mrn and k.broken is null)
        then 'mrn already in use' end as reason
      from j""",
    "ingest_encounters": f"""with b as ({_batch('encounters')})
      select submission_id, {_uuid('encounters')} as encounter_id, cast(patient_id as varchar) as patient_id,
      cast(provider_id as varchar) as provider_id,
      case when trim(chief_complaint) <> '' then chief_complaint end as chief_complaint,
      case when patient_id = -1 then 'unknown patient' when provider_id = -1 then 'unknown provider'
        when encounter_type = 'visit' then 'encounter_type not in list' end as reason from b""",
    "ingest_diagnoses": f"""with b as ({_batch('diagnoses')})
      select submission_id, {_uuid('diagnoses')} as diagnosis_id, cast(b.encounter_id as varchar) as encounter_id,
      cast(e.patient_id as varchar) as patient_id, icd10_code, coalesce(status, 'active') as status,
      case when e.encounter_id is null then 'unknown encounter'
        when description = '' then 'description is required' end as reason
      from b left join encounters e on e.encounter_id = b.encounter_id""",
    "ingest_treatments": f"""with b as ({_batch('treatments')})
      select submission_id, {_uuid('treatments')} as treatment_id, cast(e.patient_id as varchar) as patient_id,
      cast(e.provider_id as varchar) as provider_id, nullif(dosage, '') as dosage, frequency,
      coalesce(status, 'active') as status,
      case when e.encounter_id is null then 'unknown encounter'
        when treatment_name = '' then 'treatment_name is required'
        when route = 'nasal' then 'route not in list' end as reason
      from b left join encounters e on e.encounter_id = b.encounter_id""",
    "ingest_adverse_events": f"""with b as ({_batch('adverse_events')})
      select submission_id, {_uuid('adverse_events')} as event_id, cast(b.treatment_id as varchar) as treatment_id,
      cast(t.patient_id as varchar) as patient_id, ctcae_grade,
      nullif(action_taken, '') as action_taken,
      case when t.treatment_id is null then 'unknown treatment'
        when ctcae_grade = 9 then 'ctcae_grade out of range' end as reason
      from b left join treatments t on t.treatment_id = b.treatment_id""",
}


def _labs(low: str, tail: str = "") -> str:
    return f"""with b as ({_batch('lab_results')}), c as (
      select submission_id, {_uuid('lab_results')} as lab_id, cast(e.patient_id as varchar) as patient_id,
      nullif(test_name, '') as test_name, {low} as reference_low,
      cast(collected_date as timestamp) as collected_date,
      case when e.encounter_id is null then 'unknown encounter'
        when test_name = '' then 'test_name is required' end as reason
      from b left join encounters e on e.encounter_id = b.encounter_id)
      select * {tail}"""


_INGEST["ingest_labs"] = _labs("reference_low", "from c")
_INGEST["ingest_labs_zero_as_missing"] = _labs("nullif(reference_low, 0)", "from c")

def _as_text(column: str, kind) -> str:
    text = f"epoch_us({column})" if kind.typeName() == "timestamp" else column
    return f"coalesce(cast({text} as varchar), '-')"


_STREAMS = {
    "stream_lab_entry": _labs("reference_low", "from c"),
    "stream_ae_surveillance": """with w as (select severity, cast(floor(date_diff('day', date '1970-01-01', onset_date) / 7.0) as int)
        as k from adverse_events)
      select cast(date '1970-01-01' + k * 7 as date) as window_start,
      cast(date '1970-01-01' + k * 7 + 7 as date) as window_end, severity, count(*) as event_count
      from w group by k, severity""",
    "layout_roundtrip": " union all ".join(
        f"""select '{name}' as table_name, cast({table.key} as varchar) as record_id,
          concat_ws('|', {', '.join(_as_text(c, table.columns[c]) for c in COLUMNS[name])}) as record from {name}"""
        for name, table in TABLES.items()),
}


def _with_text_ids(sql: str) -> str:
    """A query over the tables with their ids as text, as the store keeps them."""
    used = [n for n in COLUMNS if re.search(rf"\b{n}\b", sql)]
    views = ", ".join(
        f"text_{n} as (select * replace ("
        + ", ".join(f"cast({c} as varchar) as {c}" for c in COLUMNS[n] if c in ID_COLUMNS) + f") from {n})" for n in used)
    body = re.sub(rf"\b({'|'.join(used)})\b", r"text_\1", sql.strip())
    return f"with {views}, {body[5:]}" if body.startswith("with ") else f"with {views} {body}"


_TABLES = {f"table_{n}": f"select * from {n}" for n in COLUMNS}


def oracle_queries() -> dict[str, str]:
    """patient_profiles itself holds nested arrays; its sizes and every field of its tabs are checked instead."""
    everything = {**_DASHBOARD, **_OVERVIEW, **_PATIENT, **_TREATMENT, **_SAFETY, **_LABS, **_PICKERS,
                  **_GRAPH, **_QUESTIONS, **_INGEST, **_STREAMS, **_TABLES}
    everything |= {f"stored_{name}": _with_text_ids(everything[name]) for name in STORED}
    return {name: _twin(sql) for name, sql in everything.items()}
