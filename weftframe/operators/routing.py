"""Send rows to named outputs, and bind parameters into SQL text."""

from __future__ import annotations

import datetime as dt
import decimal
import re
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftframe.expressions import FALSE_WORDS, TRUE_WORDS, TransformError, as_item, dtype_of, resolve, truth


def branch_flag(df: DataFrame, condition: str | Column, on_null: str = "fail") -> Column:
    """The condition as true or false; null (or unreadable) fails by default."""
    column = resolve(df, condition)
    flag = truth(column, dtype_of(as_item(df), column))
    if on_null == "fail":
        return F.coalesce(flag, F.raise_error(F.lit(f"condition has no truth value: {condition}")).cast("boolean"))
    if on_null == "false":
        return F.coalesce(flag, F.lit(False))
    if on_null == "drop":
        return flag
    raise TransformError(f"unknown null policy '{on_null}'")


def route_if(df: DataFrame, condition: str | Column, on_null: str = "fail") -> tuple[DataFrame, DataFrame]:
    """(rows where true, rows where false)."""
    flag = branch_flag(df, condition, on_null)
    item = as_item(df)
    return item.where(flag), item.where(~flag)


def _as_text(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
        return F.when(whole, column.cast("decimal(20,0)").cast("string")).otherwise(column.cast("string"))
    return column.cast("string")


def _match_text(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def route_switch(
    df: DataFrame,
    value: str | Column,
    cases: Sequence[Mapping[str, Any]],
    default: str | None = None,
    case_sensitive: bool = False,
) -> DataFrame:
    """Add ``port`` by the first matching case; no match and no default fails.

    Split the result with ``where(port = ...)`` or write it partitioned by port.
    """
    column = resolve(df, value)
    text = F.coalesce(_as_text(column, dtype_of(as_item(df), column)), F.lit(""))
    folded = text if case_sensitive else F.upper(text)
    port: Column | None = None
    for case in cases:
        match, target = case.get("match"), case.get("port")
        if match is None or not isinstance(target, str) or not target.strip():
            continue
        wanted = F.lit(_match_text(match))
        hit = folded == (wanted if case_sensitive else F.upper(wanted))
        port = F.when(hit, target) if port is None else port.when(hit, target)
    if default and default.strip():
        fallback = F.lit(default.strip())
    else:
        fallback = F.raise_error(
            F.concat(F.lit("no case matched value '"), text, F.lit("' and there is no default"))
        ).cast("string")
    return as_item(df).withColumn("port", fallback if port is None else port.otherwise(fallback))


# Python types that may be bound into a statement.
BINDABLE = (
    str,
    bool,
    int,
    float,
    decimal.Decimal,
    uuid.UUID,
    dt.date,
    dt.datetime,
    dt.timedelta,
    bytes,
    type(None),
)
_REFERENCE = re.compile(r"\{\{\s*Variable\.([A-Za-z_][\w.]*)\s*\}\}")


def check_bindable(params: Mapping[str, Any]) -> dict[str, Any]:
    """Values allowed as named markers; others are refused by name."""
    bound: dict[str, Any] = {}
    for name, value in params.items():
        if not isinstance(value, BINDABLE):
            raise TransformError(f"parameter '{name}' has unsupported type {type(value).__name__}")
        bound[name] = str(value) if isinstance(value, uuid.UUID) else value
    return bound


def typed_value(value: Any, type_name: str | None) -> Any:
    """Turn configuration text into the declared parameter type."""
    if type_name is None or not isinstance(value, str):
        return value
    kind = type_name.lower()
    text = value.strip()
    if kind in ("int", "long"):
        return int(text)
    if kind == "double":
        return float(text)
    if kind == "decimal":
        return decimal.Decimal(text)
    if kind in ("bool", "boolean"):
        if text.lower() in TRUE_WORDS:
            return True
        if text.lower() in FALSE_WORDS:
            return False
        raise TransformError(f"'{value}' is not a boolean")
    if kind == "datetime":
        return dt.datetime.fromisoformat(text)
    if kind == "guid":
        return str(uuid.UUID(text))
    return value


def lookup_variable(variables: Mapping[str, Any], dotted: str) -> Any:
    """``a.b`` in nested mappings; each step falls back to ignoring case."""
    current: Any = variables
    for segment in dotted.split("."):
        if not isinstance(current, Mapping):
            raise TransformError(f"variable '{dotted}' not found")
        if segment in current:
            current = current[segment]
            continue
        folded = [k for k in current if k.lower() == segment.lower()]
        if not folded:
            raise TransformError(f"variable '{dotted}' not found")
        current = current[folded[0]]
    return current


def bind_variables(text: str, variables: Mapping[str, Any], types: Mapping[str, str] | None = None):
    """Replace ``{{Variable.x.y}}`` by named markers; returns (sql, args)."""
    args: dict[str, Any] = {}

    def marker(match: re.Match[str]) -> str:
        dotted = match.group(1)
        name = "p_" + dotted.replace(".", "_")
        args[name] = typed_value(lookup_variable(variables, dotted), (types or {}).get(dotted))
        return f":{name}"

    return _REFERENCE.sub(marker, text), check_bindable(args)


def run_sql(
    spark: SparkSession,
    text: str,
    tables: Mapping[str, DataFrame] | None = None,
    params: Mapping[str, Any] | None = None,
    variables: Mapping[str, Any] | None = None,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Run SQL with values only ever bound, never spliced into the text.

    ``tables`` are offered to the statement by ``{name}`` placeholders.
    """
    args = check_bindable(params or {})
    if variables is not None:
        text, found = bind_variables(text, variables, types)
        args.update(found)
    return spark.sql(text, args=args or None, **(tables or {}))
