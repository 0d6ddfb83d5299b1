"""Compare a Spark query with its DuckDB oracle, ignoring the order of rows."""

from __future__ import annotations

import math

import duckdb

from ledgerloom.catalog.support import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if value is None:
        return "\x00"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "\x00nan" if math.isnan(value) else repr(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def kinds(types):
    simple = {"bigint": "int", "int": "int", "integer": "int", "smallint": "int", "hugeint": "huge",
              "string": "str", "varchar": "str", "boolean": "bool", "double": "dbl", "float": "dbl"}
    return [simple.get(str(t).lower(), str(t).lower()) for t in types]


def compare(spark, con, run, sql, sf_dir):
    """(row count, None) when equal, otherwise (row count, description of the difference)."""
    frame = run(spark, sf_dir)
    columns, mine = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = dict(zip(names, kinds([d[1] for d in cursor.description])))
    spark_types = dict(zip([f for f, _ in frame.dtypes], kinds([t for _, t in frame.dtypes])))
    other_columns, other = rows_of(names, cursor.fetchall())
    if columns != other_columns:
        return len(mine), f"columns {set(columns) ^ set(other_columns)}"
    if types != spark_types:
        return len(mine), f"types {[(k, spark_types[k], types[k]) for k in types if types[k] != spark_types[k]]}"
    if len(mine) != len(other):
        return len(mine), f"rows {len(mine)} vs {len(other)}"
    if mine != other:
        a, b = set(mine) - set(other), set(other) - set(mine)
        return len(mine), f"{len(a)} rows differ: {columns}\n  spark  {sorted(a)[:2]}\n  oracle {sorted(b)[:2]}"
    return len(mine), None
