"""Runs a query and its SQL side by side."""

import datetime
import decimal
import os

import duckdb


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def duck(sf_dir, sql):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    return names, rel.fetchall()


def rows(names, values, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(_plain(r[i]) for i in at) for r in values), key=repr)


def assert_same(df, sf_dir, sql):
    names, expected = duck(sf_dir, sql)
    order = sorted(df.columns)
    assert sorted(names) == order
    assert rows(df.columns, [tuple(r) for r in df.collect()], order) == rows(names, expected, order)
