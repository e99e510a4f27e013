"""Rows of a query against rows of its SQL, whatever their order."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def near(x, y):
    if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool):
        return abs(x - y) <= 1e-6 * max(1, abs(x), abs(y))
    return x == y


def order(row):
    return [(v is None, str(type(v) in (int, float)), f"{v:.6g}" if isinstance(v, (int, float)) else str(v)) for v in row]


def assert_same(df, sql, folder):
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=order)
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(near(x, y) for x, y in zip(a, b, strict=True)), (a, b)
