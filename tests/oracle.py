"""Compares a Spark result with the DuckDB result of its SQL: names, types, values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is None, str(type(v).__name__), str(v)) for v in row)


def _signs(row):
    """Zeros with their sign, which a hash of the bytes would see."""
    return tuple(math.copysign(1, v) for v in row if isinstance(v, float) and v == 0)


def compare(con, df, sql: str) -> list[str]:
    """Differences as short texts; an empty list means equal."""
    problems = []
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    theirs = {r[0]: r[1] for r in described}
    ours = {c: TYPES.get(t, t) for c, t in df.dtypes}
    if set(ours) != set(theirs):
        return [f"columns differ: {sorted(ours)} vs {sorted(theirs)}"]
    names = sorted(ours)
    for n in names:
        if ours[n] != theirs[n]:
            problems.append(f"type of {n}: {ours[n]} vs {theirs[n]}")
    quoted = ", ".join(f'"{n}"' for n in names)
    expected = sorted(con.execute(f"SELECT {quoted} FROM ({sql})").fetchall(), key=_key)
    actual = sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=_key)
    if len(expected) != len(actual):
        problems.append(f"rows: {len(actual)} vs {len(expected)}")
    different = [(a, e) for a, e in zip(actual, expected) if a != e or _signs(a) != _signs(e)]
    if different:
        problems.append(f"{len(different)} rows differ, first: {different[0][0]} vs {different[0][1]}"[:600])
    return problems
