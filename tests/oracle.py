"""Runs a query and its SQL on the same tables and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(tuple(str(v) for v in r) for r in frame.itertuples(index=False))


def compare(spark, run, sql, sf_dir):
    with duckdb.connect() as c:
        for t in TABLES:
            path = f"{sf_dir}/{t}.parquet"
            c.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
        expected = rows(c.execute(sql).fetch_df())
    got = rows(run(spark, sf_dir).toPandas())
    assert got == expected
