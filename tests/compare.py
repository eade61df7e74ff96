"""Rows of a Spark result and of DuckDB SQL in one comparable form."""

import glob
import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return "null" if value != value else repr(round(value, 8) + 0.0)
    if value is None:
        return "null"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def rows_of(table) -> list:
    names = sorted(table.column_names)
    columns = [table[n].to_pylist() for n in names]
    return sorted(tuple(map(plain, row)) for row in zip(*columns, strict=True))


def duck(sf_dir: str):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def duck_table(con, sql: str):
    found = con.sql(sql).arrow()
    return found.read_all() if hasattr(found, "read_all") else found
