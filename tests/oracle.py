"""Compares a query's rows with those of its SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def check(spark, query, sql, sf):
    df = query(spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)
    found = connect(sf).execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(dict(zip(columns, r, strict=True))[n]) for n in names) for r in found.fetchall()), key=str)
    assert got == want and got
