"""Run a query and its SQL and compare the rows, regardless of order."""

import math
import os

import duckdb

from assetflow.sources.views import TABLES


def database(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _value(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        number = float(v)
        return "nan" if math.isnan(number) else f"{number:.9g}"
    return str(v)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_value(r[n]) for n in names) for r in df.collect())


def rows_of_sql(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted(tuple(_value(r[i]) for i in at) for r in result.fetchall())
