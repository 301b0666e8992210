"""Comparing a Spark result with a DuckDB result as bags of rows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

_SPARK_TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
}


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs, or nothing."""
    rel = con.sql(sql)
    names = sorted(spark_df.columns)
    if names != sorted(rel.columns):
        return [f"columns {names} against {sorted(rel.columns)}"]
    ours = Counter(tuple(row[n] for n in names) for row in spark_df.collect())
    found = {n: _SPARK_TYPES.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types)}
    if found != dict(spark_df.dtypes):
        return [f"types {dict(spark_df.dtypes)} against {found}"]
    order = [rel.columns.index(n) for n in names]
    theirs = Counter(tuple(row[i] for i in order) for row in rel.fetchall())
    out = []
    if ours != theirs:
        out.append(f"{ours.total()} rows against {theirs.total()}")
        out += [f"only Spark: {row}" for row in list((ours - theirs))[:3]]
        out += [f"only SQL:   {row}" for row in list((theirs - ours))[:3]]
    return out
