"""Runs a registered query beside its DuckDB SQL and compares the rows."""

from __future__ import annotations

import math
from collections import Counter
from glob import glob
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if Path(path).is_dir() else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return str(value) if value is not None and not isinstance(value, (int, str, bool)) else value


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names), name
    order = sorted(names)
    ours = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = Counter(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in result.fetchall())
    assert ours == theirs, (name, list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
    assert ours, f"{name}: no rows"
