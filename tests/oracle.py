"""Compare a query with its SQL in DuckDB: names, then rows in any order."""

import os

import duckdb


def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        name = f.removesuffix(".parquet")
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        c.execute(f"create view {name} as select * from '{path}'")
    return c


def _rows(rows):
    return sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in rows)


def check(df, sql, sf_dir):
    got = df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect()
    want = duck(sf_dir).execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert _rows(got) == _rows([tuple(r[i] for i in at) for r in want.fetchall()])
