"""Compares a query with its SQL on the same tables."""

import glob
import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, sf_dir, fn, sql, con=None):
    """A few words on each difference; empty if equal."""
    df = fn(spark, sf_dir)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = con or connect(sf_dir)
    cur = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    out = []
    if got_columns != want_columns:
        out.append(f"columns {got_columns} != {want_columns}")
    elif len(got) != len(want):
        out.append(f"{len(got)} rows, expected {len(want)}: only here {list(set(got) - set(want))[:2]}, only there {list(set(want) - set(got))[:2]}")
    else:
        bad = [(a, b) for a, b in zip(got, want) if a != b or any(type(x) is not type(y) for x, y in zip(a, b))]
        if bad:
            out.append(f"{len(bad)} of {len(got)} rows differ, as {bad[0]}")
    return out, len(got)
