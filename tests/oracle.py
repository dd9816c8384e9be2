"""Spark query against DuckDB on the same tables: same columns, same rows in any order."""

import datetime
import math
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=str)


def connect(folder):
    con = duckdb.connect()
    con.execute("set threads to 4; set TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def same(spark, folder, query, sql):
    df = query(spark, folder)
    relation = connect(folder).sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    ours, theirs = rows(df.columns, df.collect()), rows(relation.columns, relation.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
