"""Comparison with SQL over the same tables."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.01"
HAS_SF = os.path.isdir(SF)


def rows_of(frame):
    cols = sorted(frame.columns)
    return sorted(tuple(r[c] for c in cols) for r in frame.collect())


def sql_rows(sql):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(r[i] for i in order) for r in got.fetchall())
