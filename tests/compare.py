"""Spark results against DuckDB's."""

from __future__ import annotations

import math
import os


def views(con, sf_dir: str) -> None:
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")


def _value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(_value(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _value(v)) for k, v in x.items()))
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, relation) -> None:
    assert sorted(df.columns) == sorted(relation.columns)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(relation.columns, relation.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert len(g) == len(w)
        for a, b in zip(g, w):
            same = abs(a - b) <= 1e-6 * max(1, abs(a)) if isinstance(a, float) and isinstance(b, (int, float)) else a == b
            assert same, (g, w)
