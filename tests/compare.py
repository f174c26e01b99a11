"""Rows of a Spark query against those of its SQL in DuckDB."""

import glob
import math
import os

import duckdb


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def duck(sf_dir, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    return names, r.fetchall()


def assert_same(df, sf_dir, sql):
    names, rows = duck(sf_dir, sql)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    theirs = sorted(tuple(shown(r[names.index(c)]) for c in order) for r in rows)
    ours = sorted(tuple(map(shown, r)) for r in df.select(*order).collect())
    assert ours == theirs
