"""Field paths, expressions and value coercion shared by the operators.

Expressions are Spark SQL text or ``Column`` objects. Every operator binds its
input under the alias ``item``, so ``item.age > 30`` and ``age > 30`` both work.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a number inside a string, as true or false, and as
# white space.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
TRUE_WORDS = ("true", "1", "yes", "on")
FALSE_WORDS = ("false", "0", "no", "off")
WHITE_SPACE = (
    "\t\n\u000b\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
GUID_PATTERN = (
    r"^\s*[{(]?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}[)}]?\s*$"
)

CONVERT_TARGETS = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "decimal": T.DecimalType(38, 18),
    "bool": T.BooleanType(),
    "datetime": T.TimestampType(),
    "guid": T.StringType(),
}


class TransformError(ValueError):
    """A configuration problem found before any job runs."""


def as_item(df: DataFrame) -> DataFrame:
    return df.alias("item")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def field_sql(df: DataFrame, path: str) -> str | None:
    """``a.b.0.c`` as SQL text, or None when the schema has no such field.

    Struct fields, zero-based array positions, map keys and paths into VARIANT
    columns are followed; a missing array position or map key gives null.
    """
    segments = path.split(".")
    types = {f.name: f.dataType for f in df.schema.fields}
    if path in types:
        return quoted(path)
    if segments[0] not in types:
        return None
    text, dtype = quoted(segments[0]), types[segments[0]]
    for position, segment in enumerate(segments[1:], start=1):
        if isinstance(dtype, T.StructType):
            if segment not in dtype.names:
                return None
            text, dtype = f"{text}.{quoted(segment)}", dtype[segment].dataType
        elif isinstance(dtype, T.ArrayType):
            if not segment.isdigit():
                return None
            text, dtype = f"get({text}, {int(segment)})", dtype.elementType
        elif isinstance(dtype, T.MapType):
            text, dtype = f"try_element_at({text}, {sql_text(segment)})", dtype.valueType
        elif isinstance(dtype, T.VariantType):
            steps = "".join(f"[{s}]" if s.isdigit() else f".{s}" for s in segments[position:])
            return f"try_variant_get({text}, {sql_text('$' + steps)}, 'variant')"
        else:
            return None
    return text


def sql_text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def field_path(df: DataFrame, path: str) -> Column | None:
    """:func:`field_sql` as a column."""
    text = field_sql(df, path)
    return None if text is None else F.expr(text)


def resolve(df: DataFrame, spec: str | Column) -> Column:
    """Path first, expression only when no field has that path."""
    if isinstance(spec, Column):
        return spec
    found = field_path(df, spec)
    return F.expr(spec) if found is None else found


def resolve_value(df: DataFrame, spec: Any) -> Column:
    """Like :func:`resolve`; anything that is not text is a literal."""
    if isinstance(spec, (str, Column)):
        return resolve(df, spec)
    return F.lit(spec)


def dtype_of(df: DataFrame, column: Column) -> T.DataType:
    return df.select(column.alias("_probe")).schema[0].dataType


def mentions(spec: Any, word: str) -> bool:
    """Whether expression text uses ``word`` as an identifier of its own."""
    return isinstance(spec, str) and re.search(rf"(?<![\w.`']){word}(?![\w`'(])", spec) is not None


def numeric(column: Column, dtype: T.DataType) -> Column:
    """The value as double; null where it is not a number. Booleans are not."""
    if isinstance(dtype, T.NumericType):
        return column.cast("double")
    if isinstance(dtype, T.StringType):
        return F.when(column.rlike(NUMBER_PATTERN), column.try_cast("double"))
    if isinstance(dtype, T.VariantType):
        text = F.try_variant_get(column, "$", "string")
        is_bool = F.schema_of_variant(column) == "BOOLEAN"
        return F.when(~is_bool & text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    return F.lit(None).cast("double")


def numeric_of(df: DataFrame, spec: str | Column) -> Column:
    column = resolve(df, spec)
    return numeric(column, dtype_of(df, column))


def loose_key(column: Column, dtype: T.DataType) -> Column:
    """A text key under which ``"1"``, ``"1.0"``, 1 and 1.0 are the same value."""
    if isinstance(dtype, T.IntegralType):
        return F.concat(F.lit("n:"), column.cast("string"))
    number = numeric(column, dtype)
    if isinstance(dtype, T.VariantType):
        text = F.try_variant_get(column, "$", "string")
    else:
        text = column.cast("string")
    text = F.btrim(text, F.lit(WHITE_SPACE))
    if isinstance(dtype, T.FloatType):
        text = number.cast("string")
    shown = F.coalesce(_plain_digits(text), (number + F.lit(0.0)).cast("string"))
    return F.when(number.isNotNull(), F.concat(F.lit("n:"), shown)).otherwise(F.concat(F.lit("s:"), column.cast("string")))


def _plain_digits(text: Column) -> Column:
    """A decimal number, with or without an exponent, in the one form without needless zeros; exact at any length.

    Null for other texts, and for exponents beyond those of doubles.
    """
    form = r"^([+-]?)(\d*)\.?(\d*)(?:[eE]([+-]?\d{1,3}))?$"
    sign, whole, part, power = (F.regexp_extract(text, form, i) for i in range(1, 5))
    digits = F.concat(whole, part)
    point = F.length(whole) + F.when(power == "", 0).otherwise(power.try_cast("int"))
    zeros = lambda n: F.repeat(F.lit("0"), n)
    before = F.when(point <= 0, "").otherwise(F.rpad(F.substring(digits, F.lit(1), point), point, "0"))
    after = F.when(point < 0, F.concat(zeros(-point), digits)).otherwise(F.substring(digits, F.greatest(point, F.lit(0)) + 1, F.length(digits)))
    before, after = F.ltrim(before, F.lit("0")), F.rtrim(after, F.lit("0"))
    size = F.concat(F.when(before == "", "0").otherwise(before), F.when(after == "", "").otherwise(F.concat(F.lit("."), after)))
    shown = F.when((sign == "-") & (size != "0"), F.concat(F.lit("-"), size)).otherwise(size)
    return F.when(text.rlike(form) & (digits != "") & (F.abs(point) <= 400 + F.length(digits)), shown)


def truth(column: Column, dtype: T.DataType) -> Column:
    """Boolean reading of a value: numbers by non-zero, text by the word lists."""
    if isinstance(dtype, T.BooleanType):
        return column
    if isinstance(dtype, T.NumericType):
        return column != F.lit(0)
    if isinstance(dtype, T.StringType):
        word = F.lower(F.btrim(column, F.lit(WHITE_SPACE)))
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    raise TransformError(f"cannot read {dtype.simpleString()} as a condition")


def try_convert(column: Column, dtype: T.DataType, target: str) -> Column:
    """The converted value, null where the conversion is impossible."""
    key = target.lower()
    if key not in CONVERT_TARGETS:
        raise TransformError(f"unknown convert type '{target}'")
    goal = CONVERT_TARGETS[key]
    text = column.cast("string")
    if key in ("int", "long") and isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.bround(column, 0).try_cast(goal)  # halves go to the even neighbour
    if key in ("int", "long") and isinstance(dtype, T.StringType):
        return F.when(column.rlike(r"^\s*[+-]?\d+\s*$"), column.try_cast(goal))
    if key in ("double", "decimal") and isinstance(dtype, T.StringType):
        return F.when(column.rlike(NUMBER_PATTERN), column.try_cast(goal))
    if key == "bool" and not isinstance(dtype, T.BooleanType):
        word = F.lower(F.trim(text))
        return F.when(word == "true", True).when(word == "false", False)
    if key == "guid":
        digits = F.regexp_replace(F.lower(text), "[^0-9a-f]", "")
        return F.when(
            text.rlike(GUID_PATTERN),
            F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        )
    if key == "string":
        return text
    return column.try_cast(goal)


def convert(column: Column, dtype: T.DataType, target: str, field: str = "value", on_error: str = "fail") -> Column:
    """Typed conversion. ``on_error`` is ``fail`` (abort the job) or ``null``."""
    attempt = try_convert(column, dtype, target)
    if on_error == "null":
        return attempt
    complaint = F.concat(
        F.lit(f"field '{field}': cannot convert '"), column.cast("string"), F.lit(f"' to {target}")
    )
    refusal = F.raise_error(complaint).cast(CONVERT_TARGETS[target.lower()])
    return F.coalesce(attempt, F.when(column.isNotNull(), refusal))


def literal(value: Any) -> Column:
    """A literal, also for plain dicts and lists (as struct and array)."""
    if isinstance(value, Mapping):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return F.array(*[literal(v) for v in value])
    return F.lit(value)
