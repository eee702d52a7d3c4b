"""Compare a query with its SQL twin in DuckDB, the way a result table is compared:
columns by name, rows in any order."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def sql_rows(con, sql):
    rel = con.sql(sql)
    names = sorted(rel.columns)
    places = [rel.columns.index(n) for n in names]
    return names, sorted((tuple(r[i] for i in places) for r in rel.fetchall()), key=repr)


SAME_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
              "BOOLEAN": "boolean"}


def type_differences(df, con, sql):
    rel = con.sql(sql)
    expected = {n: SAME_TYPES.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types)}
    actual = dict(df.dtypes)
    return {n: (actual.get(n), t) for n, t in expected.items()
            if actual.get(n) != t and t != '"NULL"'}
