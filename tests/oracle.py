"""DuckDB on the same tables, and rows in a form that compares."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 9) + 0.0)
    if value is not None and type(value).__name__ == "Decimal":
        return repr(int(value))
    return repr(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in df.collect())


def duck_rows(sql: str, sf_dir: str | None = None, tables: dict | None = None):
    con = duckdb.connect()
    for name in TABLES if sf_dir else ():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    for name, frame in (tables or {}).items():
        con.register(name, frame)
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in got.fetchall())
