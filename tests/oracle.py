"""Comparison of a Spark result with a DuckDB result, whatever the row order."""

import math
from glob import glob
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value if value is None else str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(cells, key=repr)


_SPARK_KINDS = {"bigint": "int", "int": "int", "double": "float", "string": "text", "boolean": "bool"}
_DUCK_KINDS = {"BIGINT": "int", "DOUBLE": "float", "VARCHAR": "text", "BOOLEAN": "bool"}


def difference(df, con, sql: str) -> str | None:
    """None if both agree in names, types and rows; else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: _DUCK_KINDS.get(str(d[1]), str(d[1])) for d in cursor.description}
    expected_names, expected = _rows(names, cursor.fetchall())
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if got_names != expected_names:
        return f"columns {got_names} instead of {expected_names}"
    got_kinds = {c: _SPARK_KINDS.get(t, t) for c, t in df.dtypes}
    if got_kinds != kinds:
        return f"types {got_kinds} instead of {kinds}"
    if len(got) != len(expected):
        return f"{len(got)} rows instead of {len(expected)}"
    for g, e in zip(got, expected):
        if g != e:
            return f"row {str(g)[:600]} instead of {str(e)[:600]}"
    return None
