"""Compares a query with its SQL on the small tables."""

from __future__ import annotations

import datetime
import decimal
import os

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str = SF):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return db


def plain(x):
    if isinstance(x, float):
        return f"{x + 0.0:.9g}"
    if isinstance(x, decimal.Decimal):
        return f"{float(x):.9g}"
    if isinstance(x, datetime.datetime):
        return str(x.replace(tzinfo=None))
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return str(x)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


def same(df, sql: str, db) -> None:
    relation = db.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    got, want = normal(df.columns, [tuple(r) for r in df.collect()]), normal(relation.columns, relation.fetchall())
    assert got == want
