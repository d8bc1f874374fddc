"""Runs registered queries against their SQL on the same tables and compares whole results."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _kind(type_name: str) -> str:
    name = type_name.upper()
    for kind, names in {
        "int": ("INT", "BIGINT", "INTEGER", "LONG", "HUGEINT"),
        "float": ("DOUBLE", "FLOAT"),
        "text": ("STRING", "VARCHAR"),
        "time": ("TIMESTAMP", "TIMESTAMP_NTZ"),
        "day": ("DATE",),
        "bool": ("BOOLEAN",),
    }.items():
        if name in names:
            return kind
    return name


def _rows(rows, order):
    plain = [tuple(row[i] for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if the results are equal, else what differs first."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    kinds = {n: _kind(str(d[1])) for n, d in zip(names, cur.description)}
    for field in df.schema.fields:
        if _kind(field.dataType.simpleString()) != kinds[field.name]:
            return f"type of {field.name}: {field.dataType.simpleString()} / {kinds[field.name]}"
    columns = sorted(names)
    expected = _rows(cur.fetchall(), [names.index(c) for c in columns])
    actual = _rows(df.collect(), [df.columns.index(c) for c in columns])
    if len(actual) != len(expected):
        return f"rows {len(actual)} / {len(expected)}"
    for a, b in zip(actual, expected):
        if not all(_same(x, y) for x, y in zip(a, b)):
            return f"row {str(a)[:300]} / {str(b)[:300]}"
    return None
