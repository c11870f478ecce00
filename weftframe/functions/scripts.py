"""User functions at table, batch, group and row level."""

from __future__ import annotations

import datetime as dt
import decimal
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from weftframe.expressions import TransformError
from weftframe.sources.catalog import sample_rows

# Input types a typed query may declare.
INPUT_TYPES: dict[str, type | tuple[type, ...]] = {
    "string": str,
    "int": int,
    "long": int,
    "double": (int, float),
    "decimal": (int, decimal.Decimal),
    "bool": bool,
    "guid": (str, uuid.UUID),
    "datetime": dt.datetime,
    "datetimeoffset": dt.datetime,
    "timespan": dt.timedelta,
}

# Groups held by one task before partial results are handed on.
PARTIAL_GROUPS = 100_000


def table_script(df: DataFrame, script: Callable[..., DataFrame], **inputs: Any) -> DataFrame:
    """A function from DataFrame (and inputs) to DataFrame, planned by Spark."""
    return df.transform(script, **inputs)


def batch_script(
    df: DataFrame, script: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str
) -> DataFrame:
    """A function from one Arrow batch of rows to rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield script(batch)

    return df.mapInPandas(run, schema)


def group_script(
    df: DataFrame,
    keys: Sequence[str],
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
) -> DataFrame:
    """A function over groups, in two steps so that no task sees a whole group.

    ``partial`` turns rows into one row per key; ``merge`` folds such rows of
    the same key into one again and must not mind how they were grouped.
    After the first step a key has at most a few rows per task.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = partial(batch)
            held = rows if held is None else merge(pd.concat([held, rows], ignore_index=True))
            if len(held) > PARTIAL_GROUPS:
                yield held
                held = None
        if held is not None:
            yield held

    return df.mapInPandas(fold, schema).groupBy(*keys).applyInPandas(merge, schema)


def for_each(
    df: DataFrame,
    body: Callable[[dict[str, Any]], Any],
    result_type: str,
    on_error: str = "capture",
    max_items: int | None = None,
    parallelism: int | None = None,
    position: str | None = None,
) -> DataFrame:
    """Call ``body`` per row; adds ``result`` and ``_error``.

    The rows' own columns pass through unchanged, and ``body`` gets them as exact
    Python values. ``capture`` leaves a null result and the message for a failed
    row, ``fail`` aborts the job. More rows than ``max_items`` are refused before
    anything runs. ``parallelism`` spreads the rows over that many tasks;
    ``position`` names a column that sorts the results in input order.
    """
    if max_items is not None and df.limit(max_items + 1).count() > max_items:
        raise TransformError(f"more than {max_items} items")
    if position:
        df = df.withColumn(position, F.monotonically_increasing_id())
    rows = df.repartition(parallelism) if parallelism else df
    added = T.StructType(
        [T.StructField("result", _parse_type(df.sparkSession, result_type)), T.StructField("_error", T.StringType())]
    )
    result_arrow = to_arrow_type(added["result"].dataType)

    def call(record: dict[str, Any]) -> tuple[Any, str | None]:
        record.pop(position, None)
        try:
            value = body(record)
            if isinstance(value, float) and value.is_integer() and pa.types.is_integer(result_arrow):
                value = int(value)
            pa.scalar(value, result_arrow)
            return value, None
        except Exception as failure:
            if on_error == "fail":
                raise
            return None, f"{type(failure).__name__}: {failure}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outcomes = [call(record) for record in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([r for r, _ in outcomes], result_arrow),
                    pa.array([e for _, e in outcomes], pa.string()),
                ],
                names=[*batch.schema.names, "result", "_error"],
            )

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added.fields]))


def _parse_type(spark: SparkSession, text: str) -> T.DataType:
    return spark.range(0).selectExpr(f"cast(null as {text}) as x").schema[0].dataType


def typed_query(
    query: Callable[..., DataFrame],
    tables: Mapping[str, DataFrame],
    inputs: Mapping[str, Any] | None = None,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Run ``query(tables, **inputs)`` after checking the declared inputs.

    A declared type ending in ``?`` allows null. Unknown tables and columns are
    reported by Spark's analysis, before any job runs.
    """
    given = dict(inputs or {})
    for name, declared in (types or {}).items():
        optional = declared.endswith("?")
        expected = INPUT_TYPES.get(declared.rstrip("?").lower())
        if expected is None:
            raise TransformError(f"input '{name}': type '{declared}' is not allowed")
        value = given.setdefault(name, None)
        if value is None:
            if not optional:
                raise TransformError(f"input '{name}' is required")
        elif not isinstance(value, expected) or (expected is int and isinstance(value, bool)):
            raise TransformError(f"input '{name}' is not a {declared}")
    if types is not None:
        unknown = set(given) - set(types)
        if unknown:
            raise TransformError(f"undeclared inputs: {', '.join(sorted(unknown))}")
    return query(_Tables(tables), **given)


class _Tables(dict):
    def __missing__(self, name: str):
        raise TransformError(f"unknown table '{name}'; known: {', '.join(sorted(self))}")


def preview(
    query: Callable[..., DataFrame],
    tables: Mapping[str, DataFrame],
    inputs: Mapping[str, Any] | None = None,
    rows: int = 5,
    generated: bool = True,
) -> DataFrame:
    """The query over generated rows of each table's schema, or over its first
    rows in the order of its columns. Nothing is written."""
    samples = {
        name: sample_rows(df.sparkSession, df.schema, rows) if generated else df.orderBy(*df.columns).limit(rows)
        for name, df in tables.items()
    }
    return typed_query(query, samples, inputs)
