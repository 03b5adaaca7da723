"""Runs a query and its SQL over the same tables and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


def rows(found, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(plain(r[i])) for i in order) for r in found)


def assert_same(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(map(tuple, df.collect()), df.columns) == rows(want.fetchall(), want.columns)
