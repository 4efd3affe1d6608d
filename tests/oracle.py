"""Compares a Spark result with the rows that DuckDB gives for the query's SQL."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 8) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def assert_same(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [list(relation.columns).index(c) for c in columns]
    got = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    want = Counter(repr([plain(r[i]) for i in at]) for r in relation.fetchall())
    assert got == want, (list((got - want))[:3], list((want - got))[:3])
