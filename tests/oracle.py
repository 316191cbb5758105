"""Runs a query on Spark and its SQL on DuckDB and compares rows."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb
import pandas as pd


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return round(value, 9)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


# Types both engines must report alike.
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
         "TIMESTAMP": "timestamp", "SMALLINT": "smallint", "DATE": "date"}


def compare(spark, con, query, sql: str, sf: str) -> tuple[int, list[str]]:
    """Row count on Spark and the differences found."""
    got = query(spark, sf)
    left = rows_of(got.columns, [tuple(r) for r in got.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: TYPES.get(str(d[1]), str(d[1]).lower()) for d in cursor.description}
    right = rows_of(names, cursor.fetchall())
    found = []
    if sorted(names) != sorted(got.columns):
        found.append(f"columns {sorted(got.columns)} != {sorted(names)}")
    unlike = {n: (t, types[n]) for n, t in got.dtypes if n in types and types[n] != t}
    if unlike:
        found.append(f"types {unlike}")
    if len(left) != len(right):
        found.append(f"rows {len(left)} != {len(right)}")
    if not found and left != right:
        in_left, in_right = set(left), set(right)
        only_left = [r for r in left if r not in in_right][:3]
        only_right = [r for r in right if r not in in_left][:3]
        found.append(f"values: spark only {only_left}; sql only {only_right}")
    return len(left), found
