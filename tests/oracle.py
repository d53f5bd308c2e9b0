"""Compares a query's rows with those of its SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def rows(names, data) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


def differences(spark, con, query, sql: str, sf_dir: str) -> list:
    got = query(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(got.columns):
        return [("columns", sorted(got.columns), sorted(names))]
    a, b = rows(got.columns, got.collect()), rows(names, cur.fetchall())
    if a == b:
        return []
    sa, sb = set(a), set(b)
    return [len(a), len(b), sorted(sa - sb)[:4], sorted(sb - sa)[:4]]
