"""Compare registered queries with their checking SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return repr(value)
    return str(value)


def rows_of_frame(df):
    names = sorted(df.columns)
    return names, sorted([tuple(_plain(r[n]) for n in names) for r in df.collect()])


def rows_of_sql(con, sql: str):
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    order = sorted(range(len(found)), key=lambda i: found[i])
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    return [found[i] for i in order], kinds, sorted([tuple(_plain(r[i]) for i in order) for r in cursor.fetchall()])


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def difference(df, con, sql: str) -> str | None:
    """Describe the first difference in names, types, or values; nothing when equal."""
    names, left = rows_of_frame(df)
    found, kinds, right = rows_of_sql(con, sql)
    if names != found:
        return f"columns {names} and {found}"
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != kinds[name]:
            return f"column {name} is {kind} and {kinds[name]}"
    if len(left) != len(right):
        return f"{len(left)} and {len(right)} rows"
    for a, b in zip(left, right):
        if a != b:
            return f"{dict(zip(names, a))} and {dict(zip(names, b))}"
    return None
