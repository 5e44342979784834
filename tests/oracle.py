"""Runs a query and its SQL twin and compares them as bags of rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(norm(v) for v in x)
    return x.isoformat(sep=" ") if hasattr(x, "hour") else str(x) if hasattr(x, "year") else x


def compare(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names), (sorted(got.columns), sorted(names))
    order = sorted(names)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    mine = sorted((tuple(norm(v) for v in r) for r in got.select(*order).collect()), key=key)
    at = [names.index(n) for n in order]
    theirs = sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=key)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    for a, b in zip(mine, theirs):
        assert a == b or all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6)) or (isinstance(y, float) and isinstance(x, int) and x == y) for x, y in zip(a, b)), (order, a, b)
    return len(mine)
