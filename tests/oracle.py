"""Run a registered query and its SQL on the same tables."""

from __future__ import annotations

import os

import duckdb


def cell(x):
    if isinstance(x, float):
        return round(x, 6)
    return bytes(x) if isinstance(x, bytearray) else x


def both(spark, query, sql: str, sf_dir: str) -> tuple[list, list, list, list]:
    df = query(spark, sf_dir)
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    rel = con.sql(sql)
    cols = sorted(df.columns)
    mine = sorted((tuple(cell(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in cols] if sorted(rel.columns) == cols else []
    theirs = sorted((tuple(cell(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    return cols, sorted(rel.columns), mine, theirs
