"""Comparison of a query's rows with its oracle in DuckDB."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, float | decimal.Decimal | int):
        return f"{float(v):.9g}" if v == v else None
    return str(v)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str)


def oracle_rows(connection, sql):
    q = connection.execute(sql)
    names = [d[0] for d in q.description]
    columns = sorted(names)
    order = [names.index(c) for c in columns]
    return columns, sorted((tuple(plain(r[i]) for i in order) for r in q.fetchall()), key=str)
