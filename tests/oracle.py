"""Compares a query's rows with those of its DuckDB SQL."""

import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    return bytes(v) if isinstance(v, bytearray) else v


def same(spark, sf, query, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df, rel = query(spark, sf), con.sql(sql)
    names = sorted(rel.columns)
    assert sorted(df.columns) == names
    key = lambda r: [(x is None, str(x)) for x in r]
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)
    want = sorted((tuple(plain(r[rel.columns.index(n)]) for n in names) for r in rel.fetchall()), key=key)
    assert got == want
