"""Compare a registered query with its SQL in DuckDB, as multisets of rows."""

from __future__ import annotations

import collections
import decimal
import math

import duckdb

from annolake.plans.fixtures import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value) if value % 1 else int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(plain(row[i]) for i in order) for row in rows)


KINDS = {
    "bigint": "bigint", "int": "int", "integer": "int", "double": "double", "float": "float", "string": "varchar",
    "varchar": "varchar", "boolean": "boolean", "hugeint": "hugeint",
}


def compare(name, spark, con, sf_dir, queries, oracles) -> str:
    """Empty when both give the same column names, types and rows, else what differs."""
    df = queries[name](spark, sf_dir)
    ours = _bag(df.columns, df.collect())
    result = con.execute(oracles[name])
    columns = [d[0] for d in result.description]
    kinds = {d[0]: KINDS.get(str(d[1]).lower(), str(d[1]).lower()) for d in result.description}
    theirs = _bag(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if ours != theirs:
        left, right = ours - theirs, theirs - ours
        return (f"rows {sum(ours.values())} vs {sum(theirs.values())}; only ours {sum(left.values())} e.g. {list(left)[:2]}; "
                f"only sql {sum(right.values())} e.g. {list(right)[:2]}; columns {sorted(columns)}")
    types = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    off = {n: (types[n], kinds[n]) for n in types if types[n] != kinds[n]}
    return f"types {off}" if off else ""
