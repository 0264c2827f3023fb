"""Compares a query with its SQL on the driver's tables, as sorted rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("LATTICA_SF", "/root/testdata/sf0.001")


def connect(sf=SF):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return x


def key(row):
    return tuple((x is not None, str(type(x)), x) if not isinstance(x, tuple) else (True, "tuple", str(x)) for x in row)


def compare(spark, c, name, query, sql, sf=SF):
    df = query(spark, sf)
    names = sorted(df.columns)
    ours = sorted((tuple(value(r[n]) for n in names) for r in df.collect()), key=key)
    c.execute(sql)
    got = [d[0] for d in c.description]
    assert sorted(got) == names, (name, names, sorted(got))
    order = [got.index(n) for n in names]
    theirs = sorted((tuple(value(r[i]) for i in order) for r in c.fetchall()), key=key)
    assert len(ours) == len(theirs), (name, len(ours), len(theirs), ours[:3], theirs[:3])
    for a, b in zip(ours, theirs, strict=True):
        assert a == b, (name, names, a, b)
    return len(ours)
