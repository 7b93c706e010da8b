"""Runs a registered query beside its SQL and compares the rows."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def norm(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(norm(x) for x in value)
    if isinstance(value, dict):
        return tuple(norm(x) for x in value.values())
    if hasattr(value, "asDict"):
        return tuple(norm(x) for x in value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(df, sql, sf_dir):
    got = rows(df.columns, df.collect())
    rel = connect(sf_dir).sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == want, ([x for x in got if x not in want][:3], [x for x in want if x not in got][:3])
    return len(got)
