"""A Spark result held against SQL on the same Parquet files."""

import glob
import os

import duckdb


def connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def text(v) -> str:
    if v is None or v != v:
        return ""
    if isinstance(v, float):
        return repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat().removesuffix("T00:00:00").replace("T", " ")
    return str(v)


def rows(table):
    """Columns and sorted rows of an Arrow table."""
    columns = sorted(table.column_names)
    return columns, sorted(tuple(text(r[c]) for c in columns) for r in table.to_pylist())


def sql_rows(con, sql: str):
    names = [c[0] for c in con.execute(sql).description]
    columns = sorted(names)
    return columns, sorted(tuple(text(dict(zip(names, r))[c]) for c in columns) for r in con.fetchall())
