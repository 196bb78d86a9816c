import datetime as dt

import pytest
from pyspark.sql import functions as F

from carestrata.operators import ingest
from carestrata.sources.retail_mapping import clinical_views
from carestrata.sources.runs import KeyIndex, RunLog
from carestrata.streaming import surveillance
from carestrata.streaming.entry import first_submissions, recorded, start_entry
from carestrata.streaming.surveillance import COUNTS, current, severity_windows, start_surveillance
from tests.comparing import rows_of
from tests.conftest import d

SUBMITTED = ("submission_id string, submitted_at timestamp, mrn string, first_name string, last_name string,"
             " date_of_birth date")


def _drop(spark, folder, name, rows):
    at = dt.datetime(2025, 8, 1, 12)
    data = [(n, at, mrn, "A", "B", d("1970-01-01")) for n, mrn in rows]
    spark.createDataFrame(data, SUBMITTED).coalesce(1).write.parquet(f"{folder}/{name}")


def _run(spark, folder, out, clinic):
    def check(batch, n):
        try:
            taken = recorded(spark, out, before_batch=n).select("mrn")
        except Exception:  # nothing recorded yet
            taken = clinic["patients"].select("mrn").limit(0)
        return ingest.ingest_patients(batch, clinic["patients"].select("mrn").union(taken), "2025-08-01")

    stream = spark.readStream.schema(SUBMITTED).option("recursiveFileLookup", "true").parquet(folder)
    start_entry(stream, check, out, f"{out}_checkpoint").awaitTermination()


def test_entry_drops_resubmissions_and_sees_earlier_batches(spark, clinic, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    _drop(spark, folder, "a", [("1", "N-1"), ("1", "N-1"), ("2", "N-2"), ("3", "M-1")])
    _run(spark, folder, out, clinic)
    assert sorted(r.mrn for r in recorded(spark, out).collect()) == ["N-1", "N-2"]
    _drop(spark, folder, "b", [("2", "N-2"), ("4", "N-1"), ("5", "N-5")])
    _run(spark, folder, out, clinic)
    assert sorted(r.mrn for r in recorded(spark, out).collect()) == ["N-1", "N-2", "N-5"]
    assert sorted(r.submission_id for r in recorded(spark, out, "rejected").collect()) == ["3", "4"]
    # years apart, in either direction: nothing is lost, and a repeat of any age stays a repeat
    old = spark.createDataFrame([("6", dt.datetime(1999, 1, 1), "N-6", "A", "B", d("1970-01-01")),
                                 ("1", dt.datetime(2031, 1, 1), "N-7", "A", "B", d("1970-01-01"))], SUBMITTED)
    old.coalesce(1).write.parquet(f"{folder}/c")
    _run(spark, folder, out, clinic)
    assert sorted(r.mrn for r in recorded(spark, out).collect()) == ["N-1", "N-2", "N-5", "N-6"]


def test_surveillance_over_several_batches_equals_batch(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    events = clinical_views(spark, small)["adverse_events"]
    folder = str(tmp_path / "in")
    # three files in no date order: windows are touched again by later batches
    for i in range(3):
        events.filter(F.col("event_id") % 3 == i).coalesce(1).write.parquet(f"{folder}/{i}")
    live = (spark.readStream.schema(events.schema).option("recursiveFileLookup", "true")
            .option("maxFilesPerTrigger", 1).parquet(folder))
    out = str(tmp_path / "out")
    start_surveillance(live, out, f"{out}_checkpoint").awaitTermination()
    assert spark.read.parquet(out).select("update").distinct().count() == 3
    assert rows_of(current(spark, out)) == rows_of(severity_windows(events))


def test_entry_rejects_nameless_rows_and_settles_repeats_by_time(spark, clinic, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = [dt.datetime(2025, 8, 1, h) for h in range(4)]
    rows = [(None, at[0], "N-1"), (None, at[0], "N-2"), (None, at[0], "N-2"), ("1", at[3], "N-3"), ("1", at[1], "N-4"),
            ("1", at[2], "N-5"), ("2", None, "N-6"), ("2", at[3], "N-2")]
    spark.createDataFrame([(i, t, m, "A", "B", d("1970-01-01")) for i, t, m in rows], SUBMITTED).repartition(3).write.parquet(f"{folder}/a")
    _run(spark, folder, out, clinic)
    assert sorted((r.submission_id, r.mrn) for r in recorded(spark, out).collect()) == [("1", "N-4"), ("2", "N-2")]
    nameless = recorded(spark, out, "rejected").collect()
    assert sorted(r.mrn for r in nameless) == ["N-1", "N-2", "N-2"]
    assert {r.reason for r in nameless} == {"submission_id is required"}


def test_equally_early_repeats_settle_the_same_way_in_any_order(spark):
    rows = [("1", "a", 1), ("1", "b", 2), ("1", None, 3)]
    found = {tuple(first_submissions(spark.createDataFrame(some, "submission_id string, x string, y int")).first())
             for some in (rows, rows[::-1], rows[1:] + rows[:1])}
    assert len(found) == 1


def test_index_opens_only_slices_that_may_hold_a_key(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path), slice_keys=100, fan=4)
    opened, read = [], []
    for n in range(20):
        index.compact(below=n)
        keys = spark.range(n * 400, n * 400 + 400).selectExpr("concat('k', id) as key")
        # ten keys that no run holds: what is opened does not grow with the runs
        assert index.known(spark.range(10).selectExpr("concat('new', id) as key"), below=n).count() == 0
        opened.append(len(index.opened))
        read.append(sum(index.log.files.size(f"{tmp_path}/{folder}/keys/slice={s}") for folder, s in index.opened))
        assert index.add(n, keys) and not index.add(n, keys)
    assert max(opened[10:]) <= 4 and len(index.log.runs()) <= 8
    held = sum(index.log.files.size(f"{index.log.path(r)}/keys") for r in index.log.runs())
    assert max(read) < held / 10
    asked = spark.createDataFrame([("k0",), ("k7999",), ("k8000",), (None,), ("k0",)], "key string")
    assert sorted(r.key for r in index.known(asked).collect()) == ["k0", "k7999"]
    assert sorted(r.key for r in index.known(asked, below=19).collect()) == ["k0"]
    assert sum(r["rows"] for r in index.log.runs()) == 8000
    assert index.known(asked.limit(0)).count() == 0


def _counted(spark, log, n, value=1):
    frame = spark.createDataFrame([(dt.datetime(2025, 1, 1 + n % 3), dt.datetime(2025, 1, 8), "mild", value)], COUNTS)
    return log.add(n, lambda path: frame.write.parquet(path) or {})


def test_fifty_updates_stay_few_files_with_the_same_sums(spark, tmp_path):
    log = RunLog(spark, str(tmp_path), fan=4)

    def merge(runs, path):
        return surveillance._write(surveillance._summed(log, runs), path)

    for n in range(50):
        assert _counted(spark, log, n, n)
        assert not _counted(spark, log, n, 1000)  # run again: counts once
        log.compact(merge, below=n)
        assert len(log.runs()) <= 11
    assert sum(r.event_count for r in current(spark, str(tmp_path)).collect()) == sum(range(50))
    assert all(log.covers(n) for n in range(50)) and not log.covers(50)
    kept = [n for n in log.files.names(str(tmp_path)) if n.startswith("update=")]
    assert len(kept) <= 11 + 4  # and what the last merge replaced


def test_a_crash_before_the_commit_of_a_merge_changes_no_sum(spark, tmp_path, monkeypatch):
    log = RunLog(spark, str(tmp_path), fan=3)
    for n in range(4):
        _counted(spark, log, n)

    def merge(runs, path):
        return surveillance._write(surveillance._summed(log, runs), path)

    with monkeypatch.context() as broken:
        broken.setattr(RunLog, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            log.compact(merge)
    assert sum(r.event_count for r in current(spark, str(tmp_path)).collect()) == 4
    assert log.compact(merge, below=2) == 0 and log.compact(merge) == 1
    assert sum(r.event_count for r in current(spark, str(tmp_path)).collect()) == 4
    assert current(spark, str(tmp_path / "none")).collect() == []
