"""Filter, project, sort, slice and page one table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftframe.expressions import (
    TransformError,
    as_item,
    dtype_of,
    numeric,
    quoted,
    resolve,
    resolve_value,
)
from weftframe.operators.indexing import TOP_N_LIMIT, with_index_if_used, with_row_index


def filter_rows(df: DataFrame, where: str | Column, on_null: str = "drop", order_by=None) -> DataFrame:
    """Rows for which ``where`` holds.

    ``on_null='fail'`` aborts when the predicate is null for a row, ``'drop'``
    leaves such rows out as SQL does. An expression that mentions ``index``
    needs ``order_by`` to say which order the index counts.
    """
    source, extra = with_index_if_used(df, [where], order_by)
    condition = where if isinstance(where, Column) else F.expr(where)
    if on_null == "fail":
        condition = F.when(
            condition.isNull(), F.raise_error(F.lit(f"predicate is null: {where}")).cast("boolean")
        ).otherwise(condition)
    kept = as_item(source).where(condition)
    return kept.drop(*extra)


def project_expression(df: DataFrame, select: str | Column, name: str = "value") -> DataFrame:
    """One column computed per row."""
    column = select if isinstance(select, Column) else F.expr(select)
    return as_item(df).select(column.alias(name))


def project_mapping(df: DataFrame, select: Mapping[str, Any]) -> DataFrame:
    """One column per entry: a field path, an expression, or a literal."""
    return as_item(df).select(*[resolve_value(df, spec).alias(target) for target, spec in select.items()])


def with_sort_keys(
    df: DataFrame, order_by: str | Column, descending: bool = False
) -> tuple[DataFrame, list[Column], list[str]]:
    """The table, its ordering columns, and the helper columns it got.

    Nulls sort lowest and numbers (also in text) by value. A computed key is
    made a column first, so that sorting does not evaluate it per comparison.
    """
    key = resolve(df, order_by)
    item = as_item(df)
    dtype = dtype_of(item, key)
    plain = isinstance(order_by, str) and order_by in df.columns
    helpers: dict[str, Column] = {}
    if isinstance(dtype, T.StringType):
        helpers["_number"] = numeric(key, dtype)
    if not plain:
        helpers["_key"] = key
    ordered = item.withColumns(helpers) if helpers else item
    names = [n for n in ("_number", "_key") if n in helpers]
    keys = [F.col(n) for n in names] + ([F.col(quoted(order_by))] if plain else [])
    return ordered, [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys], names


def sort_rows(df: DataFrame, order_by: str | Column, descending: bool = False, tiebreak=()) -> DataFrame:
    """Global sort. Rows that tie keep their input order.

    The input position also spreads a heavily repeated key over several range
    partitions, which a sort on the key alone would put into one.
    """
    ties = [F.col(t) if isinstance(t, str) else t for t in tiebreak]
    keyed, keys, helpers = with_sort_keys(df, order_by, descending)
    placed = keyed.withColumn("_position", F.monotonically_increasing_id())
    return placed.orderBy(*keys, *ties, "_position").drop("_position", *helpers)


def slice_rows(df: DataFrame, order: list[Column | str], skip: int = 0, take: int | None = None) -> DataFrame:
    """Rows ``skip .. skip+take`` of the order.

    Small windows near the front use a bounded top-n; deep or open-ended ones
    filter on a distributed row index, so nothing passes through one task.
    """
    if take is not None and skip + take <= TOP_N_LIMIT:
        front = as_item(df).orderBy(*order)
        return (front.offset(skip) if skip else front).limit(take)
    numbered = with_row_index(as_item(df), order, "_row")
    wanted = F.col("_row") >= skip
    if take is not None:
        wanted = wanted & (F.col("_row") < skip + take)
    return numbered.where(wanted).drop("_row")


@dataclass(frozen=True)
class QueryResult:
    """``result`` after slicing; ``matched`` is the filtered table before it."""

    result: DataFrame
    matched: DataFrame

    def total_count(self) -> DataFrame:
        return self.matched.agg(F.count(F.lit(1)).alias("totalCount"))


def run_query(
    df: DataFrame,
    where: str | Column | None = None,
    order_by: str | Column | None = None,
    descending: bool = False,
    skip: int | None = None,
    take: int | None = None,
    select: str | Column | Mapping[str, Any] | None = None,
    tiebreak=(),
    on_null: str = "drop",
    index_order=None,
) -> QueryResult:
    """Filter, sort, slice, project: always in this order.

    ``index_order`` is the row order that ``index`` counts in ``where``.
    """
    matched = df if where is None else filter_rows(df, where, on_null, index_order)
    result = matched
    if skip is not None or take is not None:
        if order_by is None and not tiebreak:
            raise TransformError("skip and take need order_by or tiebreak: rows have no order of their own")
        keyed, keys, helpers = matched, [], []
        if order_by is not None:
            keyed, keys, helpers = with_sort_keys(matched, order_by, descending)
        result = slice_rows(keyed, [*keys, *tiebreak], skip or 0, take).drop(*helpers)
    elif order_by is not None:
        result = sort_rows(matched, order_by, descending, tiebreak)
    if isinstance(select, Mapping):
        result = project_mapping(result, select)
    elif select is not None:
        result = project_expression(result, select)
    return QueryResult(result, matched)


@dataclass(frozen=True)
class Page:
    items: DataFrame
    info: DataFrame


def page_rows(df: DataFrame, order: list[Column | str], page: int = 1, page_size: int = 50) -> Page:
    """One page plus a one-row frame with the page arithmetic."""
    # Pages start at 1 and hold 1 to 200 rows.
    if page < 1 or not 1 <= page_size <= 200:
        raise TransformError(f"page {page} of {page_size} rows: pages start at 1 and hold 1 to 200 rows")
    number, size = page, page_size
    items = slice_rows(df, order, (number - 1) * size, size)
    total_pages = F.ceil(F.col("totalCount") / F.lit(size)).cast("long")
    info = (
        df.agg(F.count(F.lit(1)).alias("totalCount"))
        .withColumn("page", F.lit(number))
        .withColumn("pageSize", F.lit(size))
        .withColumn("totalPages", total_pages)
        .withColumn("hasNext", F.lit(number) < total_pages)
        .withColumn("hasPrevious", F.lit(number > 1))
    )
    return Page(items, info)


def evaluate_with_index(df: DataFrame, select: Mapping[str, Any], order_by) -> DataFrame:
    """:func:`project_mapping` for expressions that may use ``index``."""
    source, _ = with_index_if_used(df, list(select.values()), order_by)
    return project_mapping(source, select)


def flat_columns(schema: T.StructType, prefix: tuple[str, ...] = ()) -> list[Column]:
    """Leaf columns of nested structs under dotted names; arrays stay whole."""
    leaves: list[Column] = []
    for field in schema.fields:
        path = (*prefix, field.name)
        if isinstance(field.dataType, T.StructType):
            leaves.extend(flat_columns(field.dataType, path))
        else:
            leaves.append(F.col(".".join(quoted(p) for p in path)).alias(".".join(path)))
    return leaves
