"""Declarative record mapping: rename, default, convert, compute, flatten."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftframe.expressions import (
    TransformError,
    as_item,
    convert,
    dtype_of,
    field_path,
    literal,
    try_convert,
)
from weftframe.operators.indexing import with_index_if_used
from weftframe.operators.querying import flat_columns


@dataclass(frozen=True)
class MappedRows:
    """Mapped rows and, for ``on_error='quarantine'``, the rows set aside."""

    result: DataFrame
    rejected: DataFrame | None = None


def _raw_value(df: DataFrame, target: str, spec: Any) -> tuple[Column, str | None]:
    """Column before conversion, and the conversion asked for."""
    if isinstance(spec, Column):
        return spec, None
    if isinstance(spec, str):
        found = field_path(df, spec)
        return (F.lit(None).cast("string") if found is None else found), None
    if not isinstance(spec, Mapping):
        raise TransformError(f"mapping for '{target}' must be a path or a spec")
    if isinstance(spec.get("expression"), str):
        value = F.expr(spec["expression"])
    elif isinstance(spec.get("path"), str):
        found = field_path(df, spec["path"])
        value = F.lit(None) if found is None else found
    else:
        raise TransformError(f"mapping for '{target}' must set 'path' or 'expression'")
    if spec.get("default") is not None:
        value = F.coalesce(value, literal(spec["default"]))
    return value, spec.get("convert")


def map_rows(
    df: DataFrame,
    mapping: Mapping[str, Any],
    on_error: str = "fail",
    flatten: bool = False,
    order_by=None,
) -> MappedRows:
    """Build one output column per mapping entry.

    ``on_error`` rules conversions that fail: ``fail`` aborts, ``null`` leaves
    null, ``quarantine`` moves the row to ``rejected`` with its reasons.
    ``order_by`` is the row order that ``index`` counts in expressions.
    """
    expressions = [s.get("expression") for s in mapping.values() if isinstance(s, Mapping)]
    df, _ = with_index_if_used(df, expressions, order_by)
    source = as_item(df)
    columns: list[Column] = []
    reasons: list[Column] = []
    for target, spec in mapping.items():
        value, goal = _raw_value(df, target, spec)
        if goal is None:
            columns.append(value.alias(target))
            continue
        dtype = dtype_of(source, value)
        if on_error == "quarantine":
            attempt = try_convert(value, dtype, goal)
            columns.append(attempt.alias(target))
            reasons.append(
                F.when(
                    value.isNotNull() & attempt.isNull(),
                    F.struct(
                        F.lit(target).alias("field"),
                        F.concat(
                            F.lit("cannot convert '"), value.cast("string"), F.lit(f"' to {goal}")
                        ).alias("message"),
                    ),
                )
            )
        else:
            columns.append(convert(value, dtype, goal, target, on_error).alias(target))
    rejected = None
    if reasons:
        errors = F.array_compact(F.array(*reasons))
        marked = source.withColumn("_errors", errors)
        rejected = marked.where(F.size("_errors") > 0)
        source = as_item(marked.where(F.size("_errors") == 0).drop("_errors"))
    result = source.select(*columns)
    if flatten:
        result = flatten_fields(result)
    return MappedRows(result, rejected)


def flatten_fields(df: DataFrame) -> DataFrame:
    """Nested struct fields become columns named by their dotted path."""
    return df.select(*flat_columns(df.schema))


def record_without_nulls(df: DataFrame, name: str = "record") -> DataFrame:
    """Each row as JSON text in which null fields are absent."""
    return df.select(F.to_json(F.struct("*")).alias(name))
