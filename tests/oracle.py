"""Comparison of a query with its SQL in DuckDB, regardless of the order of rows and columns."""

from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def duck(sf_dir=SF):
    db = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def same(spark, query, sql, sf_dir=SF):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = Counter(repr(tuple(r)) for r in df.select(*names).collect())
    db = duck(sf_dir)
    found = db.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert sorted(c[0] for c in db.execute(sql).description) == names
    assert ours == Counter(map(repr, found))
