"""Compare a query's rows with its SQL on the same Parquet tables."""

import datetime
import decimal
import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return f"{v:.8g}" if v else "0"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def check(spark, query, sql):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = query(spark, DATA)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    want = sorted(tuple(value(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())
    got = sorted(tuple(value(r[c]) for c in cols) for r in df.collect())
    assert got == want and got
