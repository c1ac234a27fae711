"""Comparison of query results with SQL run by DuckDB."""

import math
import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def rows(frame):
    names = sorted(frame.columns)
    out = []
    for r in frame[names].itertuples(index=False):
        out.append(tuple(None if x is None or (isinstance(x, float) and math.isnan(x)) else x for x in r))
    return names, sorted(out, key=repr)


def by_sql(sql, folder=FOLDER):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return rows(c.execute(sql).df())


def check(spark, query, sql, folder=FOLDER):
    assert rows(query(spark, folder).toPandas()) == by_sql(sql, folder)
