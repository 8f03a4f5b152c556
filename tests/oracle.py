"""Runs a registered query on Spark and its SQL on DuckDB, and compares the rows as multisets."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter
from decimal import Decimal


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


def _plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return None if math.isnan(value) else round(value, 6)
    return value


def _rows(names, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str:
    """'' if equal, else what differs."""
    got_names, got = _rows(df.columns, df.collect())
    result = con.execute(sql)
    want_names, want = _rows([d[0] for d in result.description], result.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got != want:
        return f"rows {sum(got.values())} vs {sum(want.values())}; only spark {list((got - want).items())[:2]}; only sql {list((want - got).items())[:2]}"
    return ""
