"""Comparing a query's rows with its SQL."""

from __future__ import annotations

from collections import Counter

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(x):
    return repr(round(x, 6)) if isinstance(x, float) else repr(x)


def compare(rows, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(rows.columns) == sorted(names)
    want = Counter(tuple(_value(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    got = Counter(tuple(_value(r[c]) for c in sorted(names)) for r in rows.collect())
    assert got == want
