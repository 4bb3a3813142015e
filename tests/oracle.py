"""Runs a query and its SQL over the same tables and compares rows regardless of order."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import numpy as np


def plain(x):
    if x is None or x is duckdb:
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, (float, np.floating)):
        return None if math.isnan(x) else float(f"{float(x):.9g}") + 0.0
    if isinstance(x, (int, np.integer)):
        return float(int(x))
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return x


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).iterdir()):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else str(p) + '/*.parquet'}')")
    return con


def difference(spark, con, query, sql: str, folder: str) -> str:
    df = query(spark, folder)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    mine = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    index = [names.index(c) for c in order]
    theirs = Counter(tuple(plain(r[i]) for i in index) for r in cursor.fetchall())
    if mine == theirs:
        return ""
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only Spark: {list((mine - theirs).items())[:2]}; only SQL: {list((theirs - mine).items())[:2]}"
