"""Compare a Spark result with DuckDB SQL over the same Parquet tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return c


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "isoformat"):
        return x.isoformat()[:19]
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or hasattr(x, "as_integer_ratio"):
        return round(float(x), 6) + 0.0
    return x


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, sf_dir: str = SF_DIR) -> int:
    c = connection(sf_dir)
    result = c.execute(sql)
    names = [d[0] for d in result.description]
    wanted = rows_of(names, result.fetchall())
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(wanted), (len(got), len(wanted))
    for g, w in zip(got, wanted, strict=True):
        assert g == w or all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1, abs(a))) for a, b in zip(g, w, strict=True)), (g, w)
    return len(got)
