"""Compare a Spark result with DuckDB's: names, rows and values, any order."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (int, str)):
        return value
    if isinstance(value, Decimal):
        return repr(float(value))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    return str(value)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect())


def rows_of_duckdb(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = Counter(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())
    return [columns[i] for i in order], rows


# Type names of the two engines that mean the same.
SAME_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "smallint": "SMALLINT",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


def type_gaps(con, sql, df):
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    theirs = {r[0]: str(r[1]) for r in described}
    return {
        n: (d, theirs.get(n)) for n, d in df.dtypes if n in theirs and SAME_TYPES.get(d, d).upper() != theirs[n].upper()
    }


def difference(con, sql, df, limit=3):
    """None when equal, else a short account."""
    names, mine = rows_of_spark(df)
    other_names, theirs = rows_of_duckdb(con, sql)
    if names != other_names:
        return f"columns {names} != {other_names}"
    if mine != theirs:
        extra, missing = mine - theirs, theirs - mine
        return (
            f"rows {sum(mine.values())} vs {sum(theirs.values())}; only Spark: {list(extra)[:limit]}; "
            f"only DuckDB: {list(missing)[:limit]}"
        )
    return None
