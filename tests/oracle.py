"""Runs a query and its SQL and compares rows without regard to order."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def connection(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def same(con, sql: str, df) -> None:
    names = sorted(df.columns)
    got = sorted(tuple(plain(row[c]) for c in names) for row in df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert got == sorted(tuple(plain(row[i]) for i in order) for row in result.fetchall())
