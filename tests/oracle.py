"""Comparison of a Spark result with DuckDB's, as the driver does it: columns by name, rows in any order."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(directory):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{directory}/{t}.parquet"
        if os.path.exists(path):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return db


def cell(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else x


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in rows)


def same(df, db, sql):
    got = bag(df.columns, df.collect())
    result = db.execute(sql)
    want = bag([d[0] for d in result.description], result.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1], (list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3])
