"""Run a query's SQL twin in DuckDB over a folder of base tables and compare rows exactly."""

import decimal

import duckdb

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages"
        " benchmark labels conversations").split()


def database(directory):
    db = duckdb.connect()
    for name in BASE:
        db.execute(f"create view {name} as select * from '{directory}/{name}.parquet'")
    return db


def _plain(value):
    return value.normalize() if isinstance(value, decimal.Decimal) else value


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in df.collect())


def rows_of_sql(db, sql):
    result = db.execute(sql)
    names = [c[0] for c in result.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(repr(tuple(_plain(r[i]) for i in order)) for r in result.fetchall())


def assert_same(df, db, sql):
    columns, expected = rows_of_sql(db, sql)
    assert sorted(df.columns) == columns
    assert rows_of(df) == expected
