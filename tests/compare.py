"""Runs a query and its SQL over the same tables and compares rows as sets with repeats."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def same(value):
    return round(value, 6) if isinstance(value, float) else value


def counted(names: list[str], rows: list) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(same(r[k]) for k in order) for r in rows)


def difference(spark, query, sql: str, sf_dir: str) -> tuple[Counter, Counter]:
    """Rows that only the query has, rows that only the SQL has; column names must agree."""
    df = query(spark, sf_dir)
    names, rows = sql_rows(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    mine, theirs = counted(df.columns, [tuple(r) for r in df.collect()]), counted(names, rows)
    return mine - theirs, theirs - mine
