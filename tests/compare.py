"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math

import duckdb

from riskloom.registry.views import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return ("", "")
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, float):
        return ("f", "nan") if math.isnan(value) else ("f", value)
    return (type(value).__name__, value)


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_cell(row[i]) for i in order) for row in rows), key=repr
    )


def differences(frame, con, sql: str, limit: int = 3) -> list[str]:
    """Empty when names, rows and values agree exactly."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = _rows(cursor.fetchall(), names)
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} != {sorted(names)}"]
    actual = _rows([tuple(r) for r in frame.collect()], frame.columns)
    if len(actual) != len(expected):
        return [f"{len(actual)} rows, expected {len(expected)}"]
    return [f"{a}\n  != {e}" for a, e in zip(actual, expected) if a != e][:limit]
