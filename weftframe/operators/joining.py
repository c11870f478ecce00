"""Null-safe equi-joins of two tables, with unmatched counts."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftframe.expressions import TransformError, as_item, dtype_of, loose_key, resolve

KINDS = ("inner", "left", "full")
# Rows of a key that one task may take in a full join; how many such keys a side is searched for.
HEAVY_ROWS = 1_000_000
HEAVY_KEYS = 100
# Key types that the search for frequent keys knows, and whose values survive the way to the driver.
_COUNTED = (T.StringType, T.IntegralType, T.BooleanType, T.DateType, T.DecimalType, T.DoubleType)


@dataclass(frozen=True)
class JoinResult:
    result: DataFrame
    left_keys: DataFrame
    right_keys: DataFrame
    null_matches_null: bool = True

    def unmatched(self) -> DataFrame:
        """One row: rows of either side whose key the other side lacks.

        Both sides are counted per key before they meet, so a hot key costs
        one row here.
        """
        left = self.left_keys.groupBy("_lk").agg(F.count(F.lit(1)).alias("_ln"))
        right = self.right_keys.groupBy("_rk").agg(F.count(F.lit(1)).alias("_rn"))
        same = F.col("_lk").eqNullSafe(F.col("_rk")) if self.null_matches_null else F.col("_lk") == F.col("_rk")
        both = left.join(right, same, "full")

        def lonely(mine: str, other: str) -> Column:
            return F.coalesce(F.sum(F.when(F.col(other).isNull(), F.col(mine))), F.lit(0)).cast("long")

        return both.agg(
            lonely("_ln", "_rn").alias("unmatchedLeft"), lonely("_rn", "_ln").alias("unmatchedRight")
        )


def _keyed(df: DataFrame, key: str | Column, name: str, coerce: str | None) -> DataFrame:
    column = resolve(df, key)
    if coerce == "loose":
        column = loose_key(column, dtype_of(as_item(df), column))
    elif coerce is not None:
        raise TransformError(f"unknown coercion '{coerce}'")
    return as_item(df).withColumn(name, column)


def _project(pairs: DataFrame, select: str | Column | Mapping[str, Any]) -> DataFrame:
    if isinstance(select, Mapping):
        return pairs.select(
            *[
                (F.expr(spec) if isinstance(spec, str) else spec if isinstance(spec, Column) else F.lit(spec)).alias(
                    target
                )
                for target, spec in select.items()
            ]
        )
    return pairs.select((F.expr(select) if isinstance(select, str) else select).alias("value"))


def _heavy(keyed: DataFrame, key: str) -> tuple[dict[Any, int], int]:
    """Keys with more than ``HEAVY_ROWS`` rows and how many parts to cut each into, by a mergeable
    sketch of the most frequent items; and the same for null."""
    dtype = keyed.schema[key].dataType
    nulls = F.count_if(F.col(key).isNull()).alias("nulls")
    parts = lambda n: -(-n // HEAVY_ROWS)
    if not isinstance(dtype, _COUNTED):
        return {}, parts(keyed.agg(nulls).first()["nulls"])
    top = F.call_function("approx_top_k", F.col(key), F.lit(HEAVY_KEYS), F.lit(100 * HEAVY_KEYS)).alias("top")
    found = keyed.agg(top, nulls).first()
    heavy = {x["item"]: parts(x["count"]) for x in found["top"] or [] if x["count"] > HEAVY_ROWS and x["item"] == x["item"]}
    return heavy, parts(found["nulls"])


def _spread(lefts: DataFrame, rights: DataFrame, nulls_meet: bool) -> tuple[DataFrame, DataFrame, Column, Column]:
    """Both sides with a part number, the condition that parts meet, and which joined rows count.

    Rows of a key that is heavy on one side are dealt to parts there and repeated for
    every part on the other. The heavy side has such a key, so a repeated row has a
    partner in one part at least, and its lonely repeats in other parts go.
    """
    left_heavy, left_nulls = _heavy(lefts, "_lk")
    right_heavy, right_nulls = _heavy(rights, "_rk")
    right_heavy = {k: n for k, n in right_heavy.items() if k not in left_heavy}
    # null on the side that has more of them; on both where it meets nothing
    null_left = not nulls_meet or left_nulls >= right_nulls

    def count(key: str, heavy: dict[Any, int], nulls: int) -> Column:
        """Parts of a row's key; 1 for all that are not heavy."""
        parts = F.when(F.col(key).isNull(), F.lit(max(1, nulls))) if nulls > 1 else None
        for n in sorted(set(heavy.values())):
            here = F.col(key).isin([k for k, parts_ in heavy.items() if parts_ == n])
            parts = F.when(here, F.lit(n)) if parts is None else parts.when(here, F.lit(n))
        return (F.lit(1) if parts is None else parts.otherwise(F.lit(1))).cast("long")

    left_parts = left_nulls if null_left else 1
    right_parts = right_nulls if not nulls_meet or not null_left else 1
    dealt = lambda n: F.pmod(F.monotonically_increasing_id(), n)
    repeat = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    spread_left = lefts.withColumn("_lp", dealt(count("_lk", left_heavy, left_parts)))
    spread_right = rights.withColumn("_rp", dealt(count("_rk", right_heavy, right_parts)))
    again_left = count("_lk", right_heavy, right_parts if nulls_meet else 1)
    again_right = count("_rk", left_heavy, left_parts if nulls_meet else 1)
    if right_heavy or (nulls_meet and right_parts > 1):
        spread_left = spread_left.withColumn("_lp", F.explode(F.when(again_left > 1, repeat(again_left)).otherwise(F.array("_lp"))))
    if left_heavy or (nulls_meet and left_parts > 1):
        spread_right = spread_right.withColumn("_rp", F.explode(F.when(again_right > 1, repeat(again_right)).otherwise(F.array("_rp"))))
    lonely_left = F.col("_rp").isNull() & (again_left > 1)
    lonely_right = F.col("_lp").isNull() & (again_right > 1)
    return spread_left, spread_right, F.col("_lp") == F.col("_rp"), ~(lonely_left | lonely_right)


def join_tables(
    left: DataFrame,
    right: DataFrame,
    left_key: str | Column,
    right_key: str | Column,
    how: str = "inner",
    select: str | Column | Mapping[str, Any] | None = None,
    coerce: str | None = None,
    null_matches_null: bool = True,
    once: bool = False,
) -> JoinResult:
    """Equi-join on one key per side; null matches null unless told otherwise.

    ``select`` is written over ``left`` and ``right``. Without it the left
    fields are followed by the right record in the struct column ``right``.
    No join hint is given: Catalyst broadcasts a side only when its size is
    known to fit, and adaptive execution splits skewed keys. Where keys are
    never null, ``null_matches_null=False`` joins on the bare columns, so tables
    bucketed by the key meet without a shuffle.

    Spark does not split a full join on a skewed key. So it is a left join, which
    is split, and the right rows whose key the left side lacks; both sides are read
    twice. ``once`` reads them once instead, as a full join with the heavy keys spread
    over parts (see ``_spread``): for inputs that are costly, or not the same on every
    read. It looks through the keys, and no other column, when this is called.
    """
    if how not in KINDS:
        raise TransformError(f"joinType must be one of {', '.join(KINDS)}")
    lefts = _keyed(left, left_key, "_lk", coerce)
    rights = _keyed(right, right_key, "_rk", coerce)

    def equal(a: str, b: str) -> Column:
        return F.col(a).eqNullSafe(F.col(b)) if null_matches_null else F.col(a) == F.col(b)

    same = equal("_lk", "_rk")
    mine, other = lefts, rights
    left_columns = [F.col(f"left.`{c}`") for c in left.columns]
    if select is None:
        other = rights.select("_rk", F.struct(*[F.col(f"item.`{c}`") for c in right.columns]).alias("right"))
    right_name = "right" if select is not None else "_r"
    if how == "full" and once:
        mine, other, met, whole = _spread(mine, other, null_matches_null)
        pairs = mine.alias("left").join(other.alias(right_name), same & met, how).where(whole)
    else:
        pairs = mine.alias("left").join(other.alias(right_name), same, "inner" if how == "inner" else "left")
    if select is None:
        result = pairs.select(*left_columns, F.col("_r.right").alias("right"))
    else:
        result = _project(pairs, select)
    if how == "full" and not once:
        known = lefts.select(F.col("_lk").alias("_known")).distinct()
        alone = other.join(known, equal("_rk", "_known"), "left_anti")
        if select is None:
            result = result.unionByName(alone.select("right"), allowMissingColumns=True).select(*[F.col(f"`{c}`") for c in left.columns], "right")
        else:
            no_left = lefts.where(F.lit(False)).alias("left")
            result = result.unionByName(_project(alone.alias("right").join(no_left, F.lit(False), "left"), select))
    return JoinResult(result, lefts.select("_lk"), rights.select("_rk"), null_matches_null)
