"""Run a registered query and its DuckDB answer on the same tables, and compare."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    if hasattr(value, "item"):
        return value.item()
    return value


def rows_of(columns, records) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in records)


# DuckDB type of each Spark type that the queries return.
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def differences(spark_df, con, sql) -> str:
    """Empty if both sides have the same columns, types and rows."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = rows_of(columns, result.fetchall())
    found = rows_of(spark_df.columns, spark_df.collect())
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(columns)}"
    bad = [
        (n, t, types[n]) for n, t in spark_df.dtypes if TYPES.get(t, t).upper() != types[n].upper()
    ]
    if bad:
        return f"types {bad}"
    if found != expected:
        extra, lacking = found - expected, expected - found
        return (
            f"{sum(found.values())} rows against {sum(expected.values())};"
            f" extra {list(extra)[:3]}, lacking {list(lacking)[:3]}"
        )
    return ""
