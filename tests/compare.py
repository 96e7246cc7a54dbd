"""Runs a query and its SQL twin on the same tables and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float) and not math.isnan(v):
        return round(v, 9)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()]), dict(df.dtypes)


def duck_rows(con, sql):
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    return sorted(cols), rows_of(cols, res.fetchall()), types


def difference(left, right, limit=3):
    a, b = set(map(repr, left)), set(map(repr, right))
    return {"rows": (len(left), len(right)), "spark_only": sorted(a - b)[:limit], "sql_only": sorted(b - a)[:limit]}
