import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from carestrata.functions import labels, predicates, scalars, series
from carestrata.schema import AGE_BANDS
from tests.conftest import d, dec


def _value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("born, as_of, age", [
    ("2000-02-29", "2023-02-28", 22), ("2000-02-29", "2023-03-01", 23), ("2000-02-29", "2024-02-29", 24),
    ("1950-08-02", "2025-08-01", 74), ("1985-08-01", "2025-08-01", 40)])
def test_completed_years(spark, born, as_of, age):
    assert _value(spark, scalars.completed_years(F.lit(d(born)), as_of)) == age


@pytest.mark.parametrize("num, den, digits, expected", [
    (1, 0, 1, None), (1, 3, 1, 0.3), (5, 2, 0, 3.0), (1, 40, 2, 0.03), (4999500, 10**9, 2, 0.0)])
def test_rounded_quotient(spark, num, den, digits, expected):
    assert _value(spark, scalars.rounded_quotient(F.lit(num), F.lit(den), digits)) == expected


@pytest.mark.parametrize("baseline, result, change", [
    ("45.00", "32.00", -28.9), ("45.00", "31.50", -30.0), ("0.00", "5.00", None), (None, "5.00", None),
    ("20.00", "20.03", 0.2), ("20.00", "19.97", -0.2)])
def test_percent_change(spark, baseline, result, change):
    cols = [F.lit(dec(v)).cast("decimal(10,2)") for v in (baseline, result)]
    assert _value(spark, scalars.percent_change(*cols)) == change


def test_name_is_null_if_a_part_is(spark):
    assert _value(spark, scalars.full_name(F.lit("A"), F.lit(None).cast("string"))) is None


def test_utc_text(spark):
    at = F.lit("2025-01-15 09:00:00-06").cast("timestamp")
    assert _value(spark, scalars.utc_text(at)) == "2025-01-15 15:00:00+00"


def test_bands(spark):
    ages = spark.createDataFrame([(a,) for a in (39, 40, 54, 55, 64, 65, 74, 75, 101)], "age int")
    band = labels.band_ordinal(F.col("age"), AGE_BANDS)
    got = [r[0] for r in ages.select(labels.band_label(band, AGE_BANDS)).collect()]
    assert got == ["< 40", "40–54", "40–54", "55–64", "55–64", "65–74", "65–74", "75+", "75+"]


def test_flag_label_passes_unknown_codes_through(spark):
    df = spark.createDataFrame([("HH",), ("X",), (None,)], "f string")
    assert [r[0] for r in df.select(labels.flag_label(F.col("f"))).collect()] == ["Critical High", "X", None]


def test_facets_take_any_text(spark):
    df = spark.createDataFrame([("O'Brien's rash", "mild", None)],
                               "event_type string, severity string, resolution_date date")
    assert df.filter(predicates.ae_facets(event_type="O'Brien's rash")).count() == 1
    assert df.filter(predicates.ae_facets()).count() == 1
    assert df.filter(predicates.ae_facets(severity="severe", unresolved_only=True)).count() == 0


def test_search_keeps_wildcards(clinic):
    def found(term):
        return sorted(r.mrn for r in clinic["patients"].filter(predicates.patient_search(term)).collect())

    assert found("HOLM") == ["M-1", "M-2"]
    assert found("m_3") == ["M_3"]
    assert found("m_4") == ["M-4"]
    assert found("h%m") == ["M-1", "M-2"]


def test_missing_flag_is_not_abnormal(clinic):
    assert clinic["lab_results"].filter(predicates.abnormal()).count() == 2


@pytest.fixture(scope="module")
def walk(spark):
    """Series with ties in time, empty hours, NULLs, and one holding a third of the rows."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        group = "hot" if i % 3 == 0 else f"g{rng.randrange(40)}"
        at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=15 * rng.randrange(400))
        rows.append((group, at, i, None if i % 11 == 0 else rng.randrange(100)))
    return rows, spark.createDataFrame(rows, "g string, at timestamp_ntz, id int, v int")


def _by_group(rows):
    ordered = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    return {g: list(rs) for g, rs in itertools.groupby(ordered, key=lambda r: r[0])}


def _hours(spark_column):
    return F.floor(F.unix_seconds(spark_column.cast("timestamp")) / 3600)


@pytest.mark.parametrize("slice_rows", [5, 100, 10_000])
def test_previous(walk, slice_rows):
    rows, df = walk
    expected = {r[2]: prev for rs in _by_group(rows).values()
                for r, prev in zip(rs, [None] + [x[3] for x in rs])}
    got = series.previous(df, ["g"], ["at", "id"], "v", _hours(F.col("at")), "p", slice_rows)
    assert {r.id: r.p for r in got.collect()} == expected


def test_one_point_of_time_is_cut_into_pieces(spark):
    """A series of one timestamp, with repeated rows, and one of another group; the lags are those of a plain window."""
    at = dt.datetime(2024, 1, 1, 12)
    rows = [("hot", at, i, i % 7) for i in range(600)] + [("hot", at, 5, 5)] * 3 + [("g", at, i, i) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, at timestamp_ntz, id int, v int").repartition(4)
    stepped = df.withColumn("_step", _hours(F.col("at")))
    bounds = series.splitters(stepped, ["g", "_step"], ["at", "id"], 50).collect()
    assert [r.g for r in bounds] == ["hot"]
    cuts = [b.id for b in bounds[0]._bounds]
    assert cuts == sorted(cuts) and len(cuts) == 12  # 13 pieces of 603 rows
    sizes = [sum(lo <= r[2] < hi for r in rows[:603]) for lo, hi in zip([0, *cuts], [*cuts, 600])]
    assert sum(sizes) == 603 and max(sizes) <= 100
    expected = [(r[0], r[2], p) for rs in _by_group(rows).values() for r, p in zip(rs, [None] + [x[3] for x in rs])]
    for slice_rows in (50, 10_000):
        got = series.previous(df, ["g"], ["at", "id"], "v", _hours(F.col("at")), "p", slice_rows)
        assert sorted(map(str, ((r.g, r.id, r.p) for r in got.collect()))) == sorted(map(str, expected))
    empty = series.previous(df.filter("false"), ["g"], ["at", "id"], "v", _hours(F.col("at")), "p", 50)
    assert empty.count() == 0


def test_pieces_are_bounded_for_any_size(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("g"), F.lit(0).alias("_step"), F.col("id"))
    bounds = series.splitters(df, ["g", "_step"], ["id"], 10).first()._bounds
    assert len(bounds) == series.PIECES - 1
    places = [b.id for b in bounds]
    assert max(b - a for a, b in zip([0, *places], [*places, 20_000])) < 3 * 20_000 / series.PIECES


@pytest.mark.parametrize("slice_rows", [5, 100, 10_000])
def test_ranked(walk, slice_rows):
    rows, df = walk
    expected = {r[2]: (i, len(rs)) for rs in _by_group(rows).values() for i, r in enumerate(rs)}
    got = series.ranked(df, ["g"], [F.asc("at"), F.asc("id")], _hours(F.col("at")), "i", "n", slice_rows)
    assert {r.id: (r.i, r.n) for r in got.collect()} == expected


def test_hot_groups_are_few(walk):
    _, df = walk
    assert [r.g for r in series.hot_groups(df, ["g"], 100).collect()] == ["hot"]
    assert series.hot_groups(df, ["g"], 1000).count() == 0


def test_report_rank(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", None), ("c", 3.0), ("d", 2.0), ("e", 1.0)], "k string, v double")
    got = {r.k: r.rank for r in series.report_rank(df, "v").collect()}
    assert got == {"c": 1, "a": 2, "d": 2, "e": 4, "b": 5}


def test_stable_uuid(spark):
    one, two = (_value(spark, scalars.stable_uuid(F.lit("t"), F.lit(x))) for x in ("1", "2"))
    assert one != two and [len(p) for p in one.split("-")] == [8, 4, 4, 4, 12]
    assert one == _value(spark, scalars.stable_uuid(F.lit("t"), F.lit("1")))
