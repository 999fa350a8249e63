"""Compares a query with its SQL on DuckDB, over the same Parquet tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def connect(sf_dir: str = SMALL):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.6g}"
    return str(value)


def same_rows(df, con, sql: str) -> None:
    relation = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    got = sorted(tuple(plain(row[c]) for c in names) for row in df.collect())
    at = [relation.columns.index(c) for c in names]
    expected = sorted(tuple(plain(row[i]) for i in at) for row in relation.fetchall())
    assert got == expected
