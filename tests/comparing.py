"""Holding a query's rows against its SQL in DuckDB."""

from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 8)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def against_sql(df, sql, sf_dir=SMALL):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in got.fetchall())
    have = sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
    assert have == want
