"""JSON held in text columns: paths, merge, diff, flatten, unflatten."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftframe.functions.strings import capturing_groups
from weftframe.operators.joining import join_tables


def parse_json(text: Column, on_error: str = "fail") -> Column:
    """Text to VARIANT; blank text is null."""
    filled = F.when(F.trim(text) != "", text)
    parsed = F.try_parse_json(filled)
    if on_error == "null":
        return parsed
    refusal = F.raise_error(F.concat(F.lit("not JSON: "), filled)).cast("variant")
    return F.coalesce(parsed, F.when(filled.isNotNull(), refusal))


def to_json(value: Column) -> Column:
    """Value to JSON text, nulls written out."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def json_matches(text: Column, path: str, on_error: str = "fail") -> Column:
    """All values at a JSON path as ``array<variant>``.

    The path may hold child names, positions and any number of ``[*]``. Text
    that is no JSON fails, or with ``null`` matches nothing.
    """
    document = parse_json(text, on_error)
    head, *tails = path.split("[*]")
    if not tails:
        found = F.try_variant_get(document, head, "variant")
        return F.when(found.isNull(), F.array().cast("array<variant>")).otherwise(F.array(found))
    found = F.coalesce(F.try_variant_get(document, head, "array<variant>"), F.array().cast("array<variant>"))
    for position, tail in enumerate(tails):
        last = position == len(tails) - 1
        if last and not tail:
            break
        step = "$" + tail
        kind = "variant" if last else "array<variant>"
        found = F.filter(F.transform(found, _getter(step, kind)), lambda x: x.isNotNull())
        if not last:
            found = F.flatten(found)
    return found


def _getter(step: str, kind: str):
    return lambda v: F.try_variant_get(v, step, kind)


def unwrap_matches(matches: Column, required: bool = False, path: str = "") -> Column:
    """JSON text of the matches: a lone match by itself, otherwise a list."""
    listed = F.to_json(matches)
    single = F.to_json(F.element_at(matches, 1))
    result = F.when(F.size(matches) == 1, single).otherwise(listed)
    if required:
        missing = F.raise_error(F.lit(f"path '{path}' matched nothing")).cast("string")
        result = F.when(F.size(matches) == 0, missing).otherwise(result)
    return result


def json_path(
    df: DataFrame, text: str | Column, path: str, required: bool = False, on_error: str = "fail"
) -> DataFrame:
    """Add ``result`` (JSON text) and ``matchCount``."""
    source = F.col(text) if isinstance(text, str) else text
    return (
        df.withColumn("_matches", json_matches(source, path, on_error))
        .withColumn("result", unwrap_matches(F.col("_matches"), required, path))
        .withColumn("matchCount", F.size("_matches"))
        .drop("_matches")
    )


def json_filter(text: Column, array_path: str, predicate) -> Column:
    """Elements of the array at ``array_path`` for which ``predicate`` holds.

    ``predicate`` is a function from an element (VARIANT) to a condition.
    """
    elements = F.try_variant_get(parse_json(text), array_path, "array<variant>")
    return F.filter(F.coalesce(elements, F.array().cast("array<variant>")), predicate)


def extract_paths(text: Column, outputs: Mapping[str, str], required: bool = False) -> list[Column]:
    """One text column per output name; scalars come without quotes."""
    columns = []
    for name, path in outputs.items():
        if "[*]" in path:
            value = unwrap_matches(json_matches(text, path), required, path)
        else:
            value = F.get_json_object(text, path)
            if required:
                value = F.coalesce(value, F.raise_error(F.lit(f"path '{path}' matched nothing")).cast("string"))
        columns.append(value.alias(name))
    return columns


def extract_patterns(text: Column, outputs: Mapping[str, str]) -> list[Column]:
    """One column per output: the group called ``value`` where it takes part in the first match, else the whole match.

    A blank pattern, or one that is no regular expression, gives null; the latter with a warning.
    """
    columns = []
    for name, pattern in outputs.items():
        if not pattern.strip() or not _is_pattern(pattern):
            columns.append(F.lit(None).cast("string").alias(name))
            continue
        picked = F.regexp_extract(text, pattern, 0)
        if "(?<value>" in pattern:
            value = F.regexp_extract(text, pattern, 1 + capturing_groups(pattern[: pattern.index("(?<value>")]))
            # a reference to a group that took no part never matches; the rest holds to the first match
            left_out = text.rlike(rf"\A(?>(?s:.*?)(?>{pattern}))(?!\k<value>)")
            picked = F.when((value == "") & left_out, picked).otherwise(value)
        columns.append(F.when((text != "") & text.rlike(pattern), picked).alias(name))
    return columns


def _is_pattern(pattern: str) -> bool:
    compile_ = SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile
    try:
        compile_(pattern)
    except (Py4JJavaError, IllegalArgumentException) as refusal:
        warnings.warn(f"not a regular expression: {pattern} ({str(refusal).splitlines()[0]})", stacklevel=3)
        return False
    return True


def extract_keys(headers: Column, outputs: Mapping[str, str]) -> list[Column]:
    """One column per output from a string map, ignoring the case of keys."""
    folded = F.transform_keys(headers, lambda k, _: F.lower(k))
    return [F.try_element_at(folded, F.lit(key.lower())).alias(name) for name, key in outputs.items()]


# --- whole-document helpers; Spark calls them on Arrow batches ---------------


class _Number(float):
    """A JSON number that keeps the digits it was written with."""

    def __new__(cls, digits: str):
        number = super().__new__(cls, digits)
        number.digits = digits
        return number

    def __repr__(self) -> str:
        return self.digits

    def __reduce__(self):
        return _Number, (self.digits,)


def _load(text: str | None) -> Any:
    return None if text is None else json.loads(text, parse_float=_Number)


def _dump(value: Any) -> str:
    """JSON text; numbers with a fraction or exponent as they were written."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{_text(str(k))}:{_dump(v)}" for k, v in value.items()) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_dump, value)) + "]"
    return value.digits if isinstance(value, _Number) else _text(value)


_text = json.JSONEncoder(ensure_ascii=False, allow_nan=False).encode


def merged(target: Any, patch: Any) -> Any:
    """JSON merge patch: null removes a key, objects merge, the rest replaces."""
    if not isinstance(patch, dict):
        return patch
    result = dict(target) if isinstance(target, dict) else {}
    for key, value in patch.items():
        if value is None:
            result.pop(key, None)
        else:
            result[key] = merged(result.get(key), value)
    return result


def changes(left: Any, right: Any, path: str = "") -> Iterator[dict[str, Any]]:
    """Differences by dotted path; arrays are compared as a whole."""
    if isinstance(left, dict) and isinstance(right, dict):
        for key in dict.fromkeys([*left, *right]):
            child = f"{path}.{key}" if path else key
            if key not in left:
                yield {"op": "add", "path": child, "value": _dump(right[key])}
            elif key not in right:
                yield {"op": "remove", "path": child, "value": None}
            else:
                yield from changes(left[key], right[key], child)
    elif _dump(left) != _dump(right):
        yield {"op": "replace", "path": path, "value": _dump(right)}


def leaves(value: Any, separator: str, prefix: str = "") -> Iterator[tuple[str, Any]]:
    """Scalar leaves with their path; empty objects and arrays have none."""
    if isinstance(value, (dict, list)):
        children = value.items() if isinstance(value, dict) else enumerate(value)
        for key, child in children:
            yield from leaves(child, separator, f"{prefix}{separator}{key}" if prefix else str(key))
    else:
        yield prefix, value


def nested(pairs: Any, separator: str) -> dict[str, Any]:
    """Objects from separated keys. Digits stay keys; a later key that runs
    through a scalar replaces it."""
    root: dict[str, Any] = {}
    for key, value in pairs:
        node = root
        *parents, leaf = key.split(separator)
        for parent in parents:
            child = node.get(parent)
            if not isinstance(child, dict):
                child = {}
                node[parent] = child
            node = child
        node[leaf] = value
    return root


@F.pandas_udf(T.StringType())
def _merge_udf(base: pd.Series, patch: pd.Series) -> pd.Series:
    return pd.Series([_dump(merged(_load(b), _load(p))) for b, p in zip(base, patch)], dtype="object")


def merge_json(base: Column, patch: Column) -> Column:
    return _merge_udf(base, patch)


# Rows handed on at a time, so that a few large documents do not pile up.
_OUTPUT_ROWS = 20_000


def _explode_with(
    df: DataFrame, inputs: list[str], names: list[str], make: Callable[..., Iterator[tuple]]
) -> DataFrame:
    """Zero or more text rows per row: ``make`` gets the input cells; the other
    columns are repeated. Works on whole Arrow batches."""
    kept = [f for f in df.schema.fields if f.name not in inputs]
    schema = T.StructType([*kept, *[T.StructField(n, T.StringType()) for n in names]])

    def assemble(batch: pa.RecordBatch, origin: list[int], made: list[tuple]) -> pa.RecordBatch:
        repeated = batch.select([f.name for f in kept]).take(pa.array(origin, pa.int64()))
        texts = [pa.array([m[i] for m in made], pa.string()) for i in range(len(names))]
        return pa.RecordBatch.from_arrays([*repeated.columns, *texts], names=[f.name for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin: list[int] = []
            made: list[tuple] = []
            cells = [batch.column(n).to_pylist() for n in inputs]
            for row, values in enumerate(zip(*cells)):
                for cell in make(*values):
                    made.append(cell)
                    origin.append(row)
                    if len(made) >= _OUTPUT_ROWS:
                        yield assemble(batch, origin, made)
                        origin, made = [], []
            if made:
                yield assemble(batch, origin, made)

    return df.mapInArrow(run, schema)


def merge_by_key(base: DataFrame, patch: DataFrame, key: str, text: str) -> DataFrame:
    """Merge documents of two tables that share a key; lone documents stay.

    A base without a patch and a patch without a base need no merging (a lone
    patch only loses its nulls), so only pairs go through Python.
    """
    left = base.select(F.col(key), F.col(text).alias("_base"))
    right = patch.select(F.col(key), F.col(text).alias("_patch"))
    both = join_tables(
        left,
        right,
        key,
        key,
        "full",
        {key: F.coalesce(F.col(f"left.{key}"), F.col(f"right.{key}")), "_base": "left._base", "_patch": "right._patch"},
    ).result
    document = F.when(F.col("_patch").isNull(), F.col("_base")).otherwise(
        _merge_udf(F.coalesce("_base", F.lit("{}")), F.coalesce("_patch", F.lit("{}")))
    )
    return both.select(key, document.alias(text))


def diff_by_key(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """One row per change between documents that share a key."""
    a = left.select(F.col(key), F.col(text).alias("_left"))
    b = right.select(F.col(key).alias("_rkey"), F.col(text).alias("_right"))
    both = a.join(b, F.col(key) == F.col("_rkey"))
    differing = both.where(~F.col("_left").eqNullSafe(F.col("_right"))).select(key, "_left", "_right")

    def compare(a: str | None, b: str | None) -> Iterator[tuple]:
        return ((c["op"], c["path"], c["value"]) for c in changes(_load(a), _load(b)))

    return _explode_with(differing, ["_left", "_right"], ["op", "path", "value"], compare)


def flatten_json(df: DataFrame, text: str, separator: str = ".", position: str | None = None) -> DataFrame:
    """One row per scalar leaf: the other columns, ``path`` and ``value`` (JSON).

    ``position`` names a column for the leaf's place in the document.
    """

    def flatten(document: str | None) -> Iterator[tuple]:
        found = () if document is None else leaves(_load(document), separator)
        return ((p, _dump(v), str(i)) for i, (p, v) in enumerate(found))

    if position is None:
        return _explode_with(df, [text], ["path", "value"], flatten)
    flat = _explode_with(df, [text], ["path", "value", position], flatten)
    return flat.withColumn(position, F.col(position).cast("int"))


def unflatten_json(
    df: DataFrame, keys: list[str], separator: str = ".", name: str = "document", position: str | None = None
) -> DataFrame:
    """Rows of ``path`` and ``value`` (JSON text) back to one document per key.

    Fields come in the order of ``position``, without it in that of their paths. A
    group is one document, so its size is that of the document it makes.
    """

    @F.pandas_udf("string")
    def unflatten(paths: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series(
            [_dump(nested(zip(ps, map(_load, vs)), separator)) for ps, vs in zip(paths, values)], dtype="object"
        )

    collected = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*([position] if position else []), "path", "value"))).alias("_pairs"))
    return collected.select(*keys, unflatten("_pairs.path", "_pairs.value").alias(name))


def unflatten_map(flat: Column, separator: str = ".") -> Column:
    """A flat JSON object in text to a nested one."""

    @F.pandas_udf("string")
    def unflatten(documents: pd.Series) -> pd.Series:
        def rebuild(text):
            value = _load(text)
            return _dump(nested(value.items(), separator) if isinstance(value, dict) else {})

        return documents.map(rebuild)

    return unflatten(flat)
