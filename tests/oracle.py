"""A query against its SQL: the same columns and the same rows in any order."""

import math

import duckdb

from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 9) + 0.0
        return x

    made = [tuple(value(r[k]) for k in order) for r in rows]
    return sorted(made, key=lambda r: [(x is not None, str(type(x)) if not isinstance(x, (int, float)) else "", x) for x in r])


def compare(spark, name, query, sql, sf="sf0.001"):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{sf}/{t}.parquet')")
    made = con.sql(sql)
    want_columns, want = made.columns, made.fetchall()
    df = query(spark, f"{DATA}/{sf}")
    assert sorted(df.columns) == sorted(want_columns), name
    got = [tuple(r) for r in df.collect()]
    assert rows_of(df.columns, got) == rows_of(want_columns, want), name
    return len(got)
