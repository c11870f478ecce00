"""One aggregate per call, over a whole table or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftframe.expressions import TransformError, as_item, numeric_of, quoted, resolve
from weftframe.operators.indexing import stored

OPERATIONS = ("count", "sum", "avg", "min", "max", "first", "last", "distinct", "median", "mode")

# Rank precision of the first median pass; a sketch of it takes about a megabyte.
MEDIAN_ACCURACY = 100_000
# Steps that a bracket around the middle is cut into in each later pass.
MEDIAN_STEPS = 1_024


def _order_struct(df: DataFrame, order_by: Sequence[str | Column]) -> Column:
    return F.struct(*[resolve(df, o).alias(f"o{i}") for i, o in enumerate(order_by)])


def aggregate(
    df: DataFrame,
    operation: str,
    prop: str | Column | None = None,
    group_by: str | Column | None = None,
    order_by: Sequence[str | Column] | None = None,
) -> DataFrame:
    """``result`` for the whole table, or ``key, result, count`` per group.

    ``first``, ``last``, ``distinct`` and ``mode`` depend on row order and need
    ``order_by``. ``distinct`` gives one row per value in ``result`` with the
    number of rows holding it. Without a property they work on whole records.
    Null is a group and a value like any other.
    """
    if operation not in OPERATIONS:
        raise TransformError(f"unknown operation '{operation}'")
    if operation in ("first", "last", "distinct", "mode") and not order_by:
        raise TransformError(f"{operation} depends on row order: give order_by")
    if prop is None and operation in ("sum", "avg", "min", "max", "median"):
        raise TransformError(f"{operation} needs a property")
    if prop is None:
        prop = F.struct(*[F.col(quoted(c)) for c in df.columns])
    item = as_item(df)
    grouped = group_by is not None
    key = resolve(df, group_by) if grouped else F.lit(0)
    if operation == "median":
        return _median(item, key, numeric_of(df, prop), grouped)
    if operation in ("distinct", "mode"):
        return _by_value(item, key, resolve(df, prop), _order_struct(df, order_by), operation, grouped)
    result = _single_pass(df, operation, prop, order_by)
    if not grouped:
        return item.agg(result.alias("result"))
    return item.groupBy(key.alias("key")).agg(result.alias("result"), F.count(F.lit(1)).alias("count"))


def _single_pass(df: DataFrame, operation: str, prop, order_by) -> Column:
    if operation == "count":
        return F.count(F.lit(1))
    if operation == "first":
        return F.min_by(resolve(df, prop), _order_struct(df, order_by))
    if operation == "last":
        return F.max_by(resolve(df, prop), _order_struct(df, order_by))
    number = numeric_of(df, prop)
    if operation == "sum":
        return F.coalesce(F.sum(number), F.lit(0.0))
    return {"avg": F.avg, "min": F.min, "max": F.max}[operation](number)


def _by_value(item: DataFrame, key: Column, value: Column, order: Column, operation: str, grouped: bool) -> DataFrame:
    # Counting per (key, value) first spreads a hot key over its values and
    # leaves one small row per value for the second step.
    counted = item.groupBy(key.alias("key"), value.alias("result")).agg(
        F.count(F.lit(1)).alias("count"), F.min(order).alias("_first")
    )
    if operation == "distinct":
        columns = ["key", "result", "count"] if grouped else ["result", "count"]
        return counted.select(*columns, F.col("_first").alias("first_seen"))
    best = F.struct((-F.col("count")).alias("n"), F.col("_first").alias("f"))
    if not grouped:
        return counted.agg(F.min_by("result", best).alias("result"))
    return counted.groupBy("key").agg(F.min_by("result", best).alias("result"), F.sum("count").alias("count"))


def _median(item: DataFrame, key: Column, number: Column, grouped: bool) -> DataFrame:
    """Exact median by selection: each group's bracket around the middle narrows until it is settled.

    A bounded sketch gives the first bracket. A round then counts every unsettled
    group's rows below, above and in equal steps of its bracket; the step that holds
    the middle is the next bracket, with its own least and largest value as ends. The
    middle is settled once its step holds one value, or the two middle rows lie in two
    steps. No task sees more of a group than its steps. The rounds run when this is
    called; each reads the rows once.
    """
    rows = item.select(key.alias("key"), number.alias("v"))
    margin = 3.0 / MEDIAN_ACCURACY
    sketch = F.percentile_approx("v", [0.5 - margin, 0.5 + margin], MEDIAN_ACCURACY)
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.count("v").alias("n"), sketch.alias("b"))
    settled = F.col("n") == 0
    state = counted.select("key", "count", "n", F.col("b")[0].alias("lo"), F.col("b")[1].alias("hi"), F.lit(None).cast("double").alias("result"), settled.alias("settled"))
    state = stored(state, "median")
    done = [state.where("settled")]
    while True:
        unsettled = state.where("not settled")
        if unsettled.isEmpty():
            break
        state = stored(_narrowed(rows, unsettled), "median")
        done.append(state.where("settled"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    if grouped:
        return found.groupBy("key").agg(F.max("result").alias("result"), F.max("count").alias("count"))
    return found.agg(F.max("result").alias("result"))


def _narrowed(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """The groups of ``brackets`` after a round over ``rows``: with narrower ends, or settled."""
    held = brackets.select(F.col("key").alias("_key"), "count", "n", "lo", "hi")
    met = rows.where(F.col("v").isNotNull()).join(held, F.col("key").eqNullSafe(F.col("_key")))
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    # halves, as the distance of two doubles may be none; infinities and NaN are steps of their own
    most = float.fromhex("0x1.fffffffffffffp+1023")
    low, high = F.greatest(lo, F.lit(-most)), F.least(hi, F.lit(most))
    width = high / 2 - low / 2
    step = F.when(width > 0, F.floor((v / 2 - low / 2) / width * MEDIAN_STEPS)).when(v > low, MEDIAN_STEPS - 1).otherwise(0)
    inner = F.least(F.lit(MEDIAN_STEPS - 1), F.greatest(F.lit(0), step.cast("int")))
    place = F.when(v < lo, -2).when(v > hi, MEDIAN_STEPS + 2).when(F.isnan(v), MEDIAN_STEPS + 1).when(v > most, MEDIAN_STEPS)
    place = place.when(v < -most, -1).otherwise(inner)
    steps = met.groupBy("key", "count", "n", place.alias("place")).agg(F.count(F.lit(1)).alias("rows"), F.min("v").alias("least"), F.max("v").alias("most"))
    listed = F.array_sort(F.collect_list(F.struct("place", "rows", "least", "most")))
    folded = steps.groupBy("key", "count", "n").agg(listed.alias("steps"))
    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    none = F.lit(None).cast("struct<place: int, rows: bigint, least: double, most: double>")
    start = F.struct(F.lit(0).cast("long").alias("before"), none.alias("a"), none.alias("b"))

    def take(at: Column, x: Column) -> Column:
        upto = at["before"] + x["rows"]
        first = F.when(at["a"].isNull() & (upto >= lower), x).otherwise(at["a"])
        second = F.when(at["b"].isNull() & (upto >= upper), x).otherwise(at["b"])
        return F.struct(upto.alias("before"), first.alias("a"), second.alias("b"))

    a, b = F.col("middle.a"), F.col("middle.b")
    picked = folded.select("key", "count", "n", F.aggregate("steps", start, take).alias("middle"))
    apart = a["place"] != b["place"]
    one = a["least"] == a["most"]
    result = F.when(apart, (a["most"] + b["least"]) / 2).when(one, a["least"])
    return picked.select("key", "count", "n", a["least"].alias("lo"), a["most"].alias("hi"), result.alias("result"), (apart | one).alias("settled"))
