"""Compares a query with its SQL in DuckDB: same columns, same rows in any order."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.10g}"
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, bool) or x is None:
        return x
    return str(x) if not isinstance(x, int) else f"{float(x):.10g}" if abs(x) < 2**53 else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(con, df, sql):
    """None if equal, else what differs."""
    found = con.execute(sql)
    want = rows_of([c[0] for c in found.description], found.fetchall())
    got = rows_of(df.columns, df.collect())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] == want[1]:
        return None
    a, b = set(map(repr, got[1])), set(map(repr, want[1]))
    return f"{len(got[1])} and {len(want[1])} rows; only in Spark {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
