"""Holds a query's rows against its SQL in DuckDB."""

import math
import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def agree(spark, sf_dir, run, sql):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
    found = con.execute(sql)
    theirs = [x[0] for x in found.description]
    assert sorted(theirs) == names
    assert ours == sorted(tuple(_plain(r[theirs.index(c)]) for c in names) for r in found.fetchall())
