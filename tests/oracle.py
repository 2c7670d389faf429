"""A query's rows against those of its SQL oracle."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def text(v):
    return "" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(float(v)) if isinstance(v, float) else str(v)


def connect():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(text, r)) for r in df.select(*[f"`{n}`" for n in names]).collect())


def rows_of_sql(c, sql):
    r = c.execute(sql)
    found = [d[0] for d in r.description]
    order = [found.index(n) for n in sorted(found)]
    return sorted(found), sorted(tuple(text(x[i]) for i in order) for x in r.fetchall())
