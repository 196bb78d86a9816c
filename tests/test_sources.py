from pyspark.sql import functions as F

from carestrata.schema import TABLES
from carestrata.sources import tables
from carestrata.sources.retail_mapping import COLUMNS, clinical_views
from tests.conftest import ts
from tests.comparing import rows_of


def test_schemas_name_keys_and_references():
    assert len(TABLES) == 9
    for table in TABLES.values():
        assert next(iter(table.columns)) == table.key
        for column, (parent, key) in table.references.items():
            assert column in table.columns and key in TABLES[parent].columns


def test_layout_roundtrip_and_append(spark, clinic, tmp_path):
    where = str(tmp_path)
    for name, df in clinic.items():
        tables.write_layout(df, where, name)
    back = tables.load_all(spark, where)
    for name, df in clinic.items():
        assert back[name].schema.names == list(TABLES[name].columns)
        assert rows_of(back[name]) == rows_of(df)
    more = tables.literal_rows(spark, "encounters", [dict(
        encounter_id="e9", patient_id="p2", provider_id="v2", encounter_type="telehealth",
        admission_date=ts("2024-05-01T00:00"))])
    assert tables.append_records(more, where, "encounters") == 1
    assert tables.append_records(clinic["lab_results"], where, "lab_results") == 4
    assert tables.load(spark, where, "encounters").count() == 5


def test_date_bounds_prune_year_folders(spark, clinic, tmp_path):
    where = str(tmp_path)
    tables.write_layout(clinic["lab_results"], where, "lab_results")
    df = tables.load(spark, where, "lab_results", since="2025-01-08", until="2025-01-08")
    assert df.count() == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_mapping_has_unique_keys_and_no_orphans(spark):
    views = clinical_views(spark, "/root/testdata/sf0.001")
    assert set(views) == set(COLUMNS) == set(TABLES)
    for name in views:
        key = next(iter(COLUMNS[name]))
        total, distinct = views[name].agg(F.count("*"), F.countDistinct(key)).first()
        assert total == distinct > 0
    for child in ("encounters", "treatments", "adverse_events", "lab_results"):
        assert views[child].join(views["patients"], "patient_id", "left_anti").count() == 0
