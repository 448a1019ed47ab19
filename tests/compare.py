"""Rows of a Spark query and of its SQL in DuckDB, in a form that compares."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def value(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, int):
        return repr(float(x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(tuple(value(r[k]) for k in order) for r in rows)


def from_spark(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def from_duckdb(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    return rows_of([d[0] for d in got.description], got.fetchall())
