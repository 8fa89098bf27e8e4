"""Rows of a Spark frame and of DuckDB, in a form in which they can be compared."""

import decimal

import duckdb

from folioflow.session import TABLES


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*[f"`{c}`" for c in names]).collect())


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    quoted = ", ".join(f'"{c}"' for c in names)
    return names, sorted(repr(tuple(plain(x) for x in r)) for r in rel.select(quoted).fetchall())
