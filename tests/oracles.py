"""Comparing a query with its SQL."""

import glob
import os

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        at = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{at}'")
    return con


def canonical(frame):
    def one(v):
        if v is None or v != v or str(v) in ("<NA>", "NaT"):
            return "~"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(one, r)) for r in frame.itertuples(index=False))


def check(query, sql, spark, sf_dir):
    ours, theirs = query(spark, sf_dir).toPandas(), connection(sf_dir).sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    as_float = [c for c in ours.columns if ours[c].dtype.kind == "f" or theirs[c].dtype.kind == "f"]
    for c in as_float:
        ours[c], theirs[c] = ours[c].astype(float), theirs[c].astype(float)
    assert canonical(ours) == canonical(theirs)
