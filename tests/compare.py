"""Side-by-side run of a query and its SQL twin."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SPARK_TO_SQL = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "timestamp": "TIMESTAMP",
}


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return f"{value:.9g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    expected = _rows(names, rel.fetchall())
    mine = {f.name: SPARK_TO_SQL.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    if set(mine) != set(names):
        return f"columns {sorted(mine)} <> {sorted(names)}"
    wrong = {c: (mine[c], types[c]) for c in mine if mine[c] != types[c]}
    if wrong:
        return f"types {wrong}"
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(expected):
        extra = sorted(set(got) - set(expected))[:2], sorted(set(expected) - set(got))[:2]
        return f"rows {len(got)} <> {len(expected)}: {str(extra)[:700]}"
    bad = [(a, b) for a, b in zip(got, expected) if a != b]
    if bad:
        only = sorted(set(got) - set(expected))[:2], sorted(set(expected) - set(got))[:2]
        return f"{len(bad)} values differ in {sorted(names)}: {str(only)[:900]}"
    return None
