"""Compare queries with their SQL in DuckDB: names, row counts and values, whatever the order of rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda x: "" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x)
    for c in frame.columns:  # a nullable integer column reads as float
        if frame[c].dtype.kind == "f" and frame[c].isna().any() and (frame[c].dropna() % 1 == 0).all():
            frame[c] = frame[c].astype("Int64")
    return sorted(tuple("" if v is None or v is x else v for v in map(lambda x: "" if str(x) == "<NA>" else show(x), r)) for r in frame.itertuples(index=False) for x in [None])


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def same(spark, sf_dir, run, sql):
    got, want = run(spark, sf_dir).toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns), (list(got.columns), list(want.columns))
    a, b = rows_of(got), rows_of(want)
    assert len(a) == len(b), (len(a), len(b), a[:2], b[:2])
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, (len(bad), bad[:3])
