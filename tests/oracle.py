"""Runs a query and its DuckDB SQL over the same Parquet tables and compares their rows."""

from __future__ import annotations

import math
import os

import duckdb


def norm(v) -> str:
    if v is None:
        return "\0"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def rows_of(df) -> list[tuple[str, ...]]:
    columns = sorted(df.columns)
    return sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())


def oracle_rows(sql: str, folder: str) -> tuple[list[str], list[tuple[str, ...]]]:
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}" if os.path.isfile(f"{folder}/{f}") else f"{folder}/{f}/*.parquet"
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    rel = con.sql(sql.strip().rstrip(";"))
    columns = sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    return columns, sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def same(df, sql: str, folder: str) -> None:
    columns, want = oracle_rows(sql, folder)
    assert sorted(df.columns) == columns
    assert rows_of(df) == want
