"""Rows of a query and of its SQL in another engine, made comparable."""

import math
from pathlib import Path

import duckdb


def connection(folder):
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"CREATE VIEW \"{p.stem}\" AS SELECT * FROM '{source}'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else f"{v:.9g}"
        return None if v is None else str(v)

    return sorted(columns), sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


def same(spark, folder, query, sql):
    df = query(spark, folder)
    mine = canonical(df.columns, df.collect())
    got = connection(folder).execute(sql)
    theirs = canonical([d[0] for d in got.description], got.fetchall())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]
    return len(mine[1])
