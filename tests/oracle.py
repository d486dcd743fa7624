"""Compares queries with their SQL: rows as multisets, columns by name, doubles to nine digits."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(x):
    return float(f"{x:.9g}") if isinstance(x, float) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(same(r[i]) for i in order) for r in rows)


def compare(spark, query, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    df = query(spark, folder)
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert got[1] == want[1], (list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3])
