"""Spark results against DuckDB's on the same Parquet tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same(spark, query, sql: str, sf_dir: str) -> None:
    """Equal column names and equal rows, in any order."""
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(columns).collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
