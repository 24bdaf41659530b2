"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, dt.datetime):
        return v.date() if v.time() == dt.time() else v
    return v


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    cursor = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cursor.description}
    want = bag(list(types), cursor.fetchall())
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    found = []
    if sorted(types) != sorted(df.columns):
        found.append(f"columns {sorted(df.columns)} against {sorted(types)}")
    same = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean",
            "DOUBLE": "double", "DATE": "date", "NUMBER": ""}
    for name, kind in df.dtypes:
        if same.get(types.get(name, ""), kind) != kind:
            found.append(f"type of {name}: {kind} against {types[name]}")
    if got != want:
        found.append(f"{sum(got.values())} rows against {sum(want.values())}")
        found += [f"only here {r}" for r in list((got - want))[:4]]
        found += [f"only in sql {r}" for r in list((want - got))[:4]]
    return found
