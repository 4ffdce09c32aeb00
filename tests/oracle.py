"""Runs a query and its SQL side by side and compares rows as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, f, sql, sf_dir):
    """None if both give the same, else what differs."""
    df = f(spark, sf_dir)
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    b = rows_of(rel.columns, rel.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows; {[x for x in a[1][:3]]} {[x for x in b[1][:3]]}"
    for x, y in zip(a[1], b[1]):
        if x != y:
            return f"{x} and {y}"
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
    got = {n: kinds.get(t, t) for n, t in df.dtypes}
    want = dict(zip(rel.columns, map(str, rel.types)))
    if got != want:
        return f"types {[(n, got[n], want[n]) for n in got if got[n] != want[n]]}"
    return None
