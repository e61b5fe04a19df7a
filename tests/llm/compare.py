"""Spark's rows against DuckDB's for the same tables."""

import duckdb
import pyarrow as pa


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    got = con.sql(sql)
    return got.columns, got.fetchall()


def arrow(rows, columns, types=None):
    return pa.table({c: pa.array([r[i] for r in rows], types[i] if types else None) for i, c in enumerate(columns)})


def same(df, columns, rows, digits=9):
    def plain(r):
        return tuple(round(x, digits) if isinstance(x, float) else x for x in r)

    left = sorted((plain(tuple(r)) for r in df.select(*columns).collect()), key=repr)
    right = sorted((plain(r) for r in rows), key=repr)
    assert left == right
