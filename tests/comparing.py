"""Compares a registered query with its SQL on the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def sorted_rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    kept = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(kept, key=repr)


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
}


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs, in words; empty when nothing does."""
    result = con.execute(sql)
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in result.description}
    want_columns, want = sorted_rows([d[0] for d in result.description], result.fetchall())
    got_columns, got = sorted_rows(df.columns, df.collect())
    if want_columns != got_columns:
        return [f"columns {got_columns} instead of {want_columns}"]
    found = [f"{n} is {t} instead of {kinds[n]}" for n, t in df.dtypes if t != kinds[n]]
    if len(want) != len(got):
        found.append(f"{len(got)} rows instead of {len(want)}")
    if want != got:
        missing = list((set(want) - set(got)))[:3]
        extra = list((set(got) - set(want)))[:3]
        found.append(f"missing {missing}, extra {extra}")
    return found
