"""Comparison of a query with its SQL counterpart on the same tables."""

import glob
import os

import duckdb


def cell(x):
    if x is None or x != x:
        return "NULL"
    if isinstance(x, float):
        return repr(round(x, 6))
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(cell(y) for y in x) + "]"
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def sql_rows(sql, sf):
    con = duckdb.connect()
    for f in glob.glob(sf + "/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    r = con.sql(sql)
    return sorted(r.columns), rows(r.columns, r.fetchall())
