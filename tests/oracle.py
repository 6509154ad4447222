"""Runs a query's SQL in DuckDB and compares its rows with Spark's, in any order."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

from morphlake.sources.tables import NAMES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in NAMES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, int):
        return float(f"{float(x):.9g}") if abs(x) < 2**53 else x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return str(x)


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    """Nothing if the rows are the same."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} and {sorted(names)}"]
    want, got = rows_of(names, cur.fetchall()), rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    out = [f"missing {r}" for r in list((want - got).elements())[:3]] + [f"extra {r}" for r in list((got - want).elements())[:3]]
    return [f"{sum(want.values())} rows wanted, {sum(got.values())} found", *out] if out else []
