"""JSON Schema as Spark conditions.

A schema is compiled against the type of the rows. Structs, arrays and maps are
followed by their types; VARIANT values tell their types row by row. Everything
becomes Columns over one pass; nothing runs in Python.

Meaning of empty values: a null of a typed column counts as not given, so it
passes every keyword but a ``required`` of the object around it. The null inside
a VARIANT is JSON's own null, a value like others.

Locations are JSON pointers into the row (``/lines/2/price``). ``anyOf``,
``oneOf``, ``not`` and ``contains`` give one error at the place they stand for;
the failures inside their branches are not listed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftframe.expressions import TransformError

ERROR_TYPE = "array<struct<field:string,rule:string,message:string>>"
# A recursive schema is spelled out as deep as the rows are nested; beyond this many nodes it is refused.
MOST_NODES = 5_000

# schema_of_variant's words for the types of JSON.
_SHAPES = {
    "string": "^STRING",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)",
    "boolean": "^BOOLEAN",
    "array": "^ARRAY",
    "object": "^OBJECT",
    "null": "^VOID",
}
# Keywords whose meaning depends on what other keywords have looked at.
_REFUSED = {"unevaluatedItems", "unevaluatedProperties", "$dynamicRef", "$recursiveRef"}


@dataclass(frozen=True)
class Check:
    """One condition on a table: what has to hold and what to say if it fails."""

    holds: Column
    field: str | Column
    rule: str
    message: str

    def failed(self) -> Column:
        return ~F.coalesce(self.holds, F.lit(False))

    def violation(self) -> Column:
        return F.when(
            self.failed(),
            F.struct(
                F.lit(self.field).alias("field"),
                F.lit(self.rule).alias("rule"),
                F.lit(self.message).alias("message"),
            ),
        )

    def under(self, condition: Column) -> Check:
        return replace(self, holds=~condition | self.holds)


@dataclass(frozen=True)
class EntryChecks:
    """Conditions on the entries of an array or object, whose number differs from row to row."""

    every: Callable[[], Column]
    listed: Callable[[], Column]

    @property
    def holds(self) -> Column:
        return self.every()

    def failed(self) -> Column:
        return ~F.coalesce(self.holds, F.lit(False))

    def violations(self) -> Column:
        return F.coalesce(self.listed(), F.array().cast(ERROR_TYPE))

    def under(self, condition: Column) -> EntryChecks:
        return EntryChecks(
            lambda: ~condition | self.every(),
            lambda: F.when(condition, self.listed()).otherwise(F.array().cast(ERROR_TYPE)),
        )


AnyCheck = Check | EntryChecks


def all_violations(checks: Sequence[AnyCheck]) -> Column:
    """The errors of all checks in one array."""
    single = [c.violation() for c in checks if isinstance(c, Check)]
    lists = [c.violations() for c in checks if isinstance(c, EntryChecks)]
    if single:
        lists.insert(0, F.array_compact(F.array(*single)))
    if not lists:
        return F.array().cast(ERROR_TYPE)
    return F.concat(*lists) if len(lists) > 1 else lists[0]


def all_hold(checks: Sequence[AnyCheck]) -> Column:
    together = F.lit(True)
    for check in checks:
        together = together & F.coalesce(check.holds, F.lit(False))
    return together


def schema_checks(df: DataFrame, schema: Any, value: Column, dtype: T.DataType) -> list[AnyCheck]:
    """Checks of ``value``, a column of ``df``, one for each keyword and location."""
    return list(_Compiler(df, schema, value).checks(_Place(value, dtype, ""), schema, "schema", ()))


def _escaped(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def _escaped_column(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


@dataclass(frozen=True)
class _Place:
    """A value inside the row: its column, its type and its JSON pointer."""

    value: Column
    dtype: T.DataType
    pointer: str | Column
    level: int = 0
    base: Column | None = None  # the VARIANT that ``path`` starts from
    path: str = "$"

    def _get(self, kind: str) -> Column:
        return F.try_variant_get(self.value if self.base is None else self.base, self.path, kind)

    def _below(self, part: str, name: str) -> _Place:
        """A member or entry of a VARIANT, read from where the path starts and not from the value between."""
        base, path = self.value if self.base is None else self.base, self.path + part
        return replace(self._step(F.try_variant_get(base, path, "variant"), self.dtype, name), base=base, path=path)

    @property
    def loose(self) -> bool:
        return isinstance(self.dtype, T.VariantType)

    def _step(self, value: Column, dtype: T.DataType, name: str | Column) -> _Place:
        if isinstance(name, str) and isinstance(self.pointer, str):
            pointer: str | Column = f"{self.pointer}/{_escaped(name)}"
        else:
            pointer = F.concat(F.lit(self.pointer), F.lit("/"), F.lit(_escaped(name)) if isinstance(name, str) else name)
        return _Place(value, dtype, pointer, self.level + 1)

    def is_a(self, kind: str) -> bool | Column:
        """Whether the value is of a JSON type; known beforehand but for VARIANT."""
        if self.loose:
            return F.coalesce(F.schema_of_variant(self.value).rlike(_SHAPES[kind]), F.lit(False))
        types = {
            "string": (T.StringType, T.CharType, T.VarcharType),
            "number": T.NumericType,
            "boolean": T.BooleanType,
            "array": T.ArrayType,
            "object": (T.StructType, T.MapType),
            "null": T.NullType,
        }
        return isinstance(self.dtype, types[kind])

    def text(self) -> Column:
        return self._get("string") if self.loose else self.value

    def number(self, kind: str = "double") -> Column:
        return self._get(kind) if self.loose else self.value.try_cast(kind)

    def is_whole(self) -> Column | bool:
        if isinstance(self.dtype, T.IntegralType):
            return True
        number = self.is_a("number")
        if number is False:
            return False
        whole = F.coalesce(self.number() == F.floor(self.number()), F.lit(False))
        return whole if number is True else number & whole

    def entries(self) -> tuple[Column, T.DataType]:
        if self.loose:
            return self._get("array<variant>"), T.VariantType()
        return self.value, self.dtype.elementType

    def entry(self, i: int) -> _Place:
        if self.loose:
            return self._below(f"[{i}]", str(i))
        values, dtype = self.entries()
        return self._step(F.get(values, F.lit(i)), dtype, str(i))

    def entry_at(self, value: Column, i: Column | None) -> _Place:
        return self._step(value, self.entries()[1], F.lit("") if i is None else i.cast("string"))

    def members(self) -> tuple[Column, T.DataType]:
        """Names and values of an object that is no struct."""
        if self.loose:
            return self._get("map<string,variant>"), T.VariantType()
        return self.value, self.dtype.valueType

    def member_at(self, name: Column, value: Column) -> _Place:
        return self._step(value, self.members()[1], _escaped_column(name))

    def names(self) -> Column:
        if isinstance(self.dtype, T.StructType):
            given = [F.when(self.value.getField(f.name).isNotNull(), F.lit(f.name)) for f in self.dtype.fields]
            return F.array_compact(F.array(*given)) if given else F.array().cast("array<string>")
        members, dtype = self.members()
        if not isinstance(dtype, T.VariantType):
            members = F.map_filter(members, lambda _, v: v.isNotNull())
        return F.map_keys(members)

    def member(self, name: str) -> _Place | None:
        """The member of that name; None where the type has none."""
        if isinstance(self.dtype, T.StructType):
            for field in self.dtype.fields:
                if field.name == name:
                    return self._step(self.value.getField(name), field.dataType, name)
            return None
        if isinstance(self.dtype, T.MapType) or self.loose:
            members, dtype = self.members()
            if self.loose and not set(name) & set("'\"\\"):
                return self._below(f"['{name}']", name)
            return self._step(F.try_element_at(members, F.lit(name)), dtype, name)
        return None

    def key(self) -> Column:
        """Text that is equal for equal JSON values: 1 and 1.0 are, 1 and "1" are not."""
        if isinstance(self.dtype, T.IntegralType):
            return self.value.cast("string")
        if isinstance(self.dtype, (T.FloatType, T.DoubleType)):
            return _plain(self.value.cast("string").cast("double"))
        value = self.value
        if isinstance(self.dtype, (T.StructType, T.ArrayType, T.MapType)):
            value = F.parse_json(F.to_json(value))
        elif not self.loose:
            value = value.cast("variant")
        if not self.loose:
            return F.to_json(value)
        # whole and decimal numbers are stored without needless zeros
        return F.when(F.schema_of_variant(value).isin("DOUBLE", "FLOAT"), _plain(self.number())).otherwise(F.to_json(value))


def _plain(number: Column) -> Column:
    """A double in the form that JSON text has for the same decimal number."""
    exact = number.try_cast("decimal(38,18)")
    shown = F.regexp_replace(exact.cast("string"), r"\.?0+$", "")
    return F.when(exact.isNotNull() & (exact.cast("double") == number), shown).otherwise(number.cast("string"))


def _key_of(value: Any) -> Column:
    return _Place(F.parse_json(F.lit(json.dumps(value))), T.VariantType(), "").key()


def _decimal_digits(number: Any) -> str:
    return format(number, "f") if isinstance(number, float) else str(number)


class _Compiler:
    def __init__(self, df: DataFrame, root: Any, value: Column):
        self.df, self.root, self.value = df, root, value
        self.deepest: int | None = None
        self.nodes = 0

    def checks(self, at: _Place, schema: Any, keyword: str, refs: tuple[tuple[int, int], ...]) -> Iterator[AnyCheck]:
        if isinstance(schema, bool):
            if not schema:
                yield Check(at.value.isNull(), at.pointer, keyword, "nothing is allowed here")
            return
        if not isinstance(schema, Mapping):
            raise TransformError(f"{keyword}: a schema is an object or a boolean")
        self.nodes += 1
        if self.nodes > MOST_NODES:
            raise TransformError(f"schema of more than {MOST_NODES} nodes, counting each use of a reference")
        for refused in _REFUSED & set(schema):
            raise TransformError(f"JSON Schema keyword '{refused}' is not supported")
        for name, expected in schema.items():
            if name == "$ref":
                yield from self._reference(at, expected, refs)
            elif name in _COMBINED:
                yield from _COMBINED[name](self, at, schema, expected, refs)
            elif name in _SINGLE:
                kind, condition = _SINGLE[name]
                yield from _of_kind(at, kind, lambda: condition(at, expected), name, expected)

    def holds(self, at: _Place, schema: Any, refs) -> Column:
        return all_hold(list(self.checks(at, schema, "schema", refs)))

    # references

    def _reference(self, at: _Place, target: str, refs) -> Iterator[AnyCheck]:
        schema = self._find(target)
        if (id(schema), at.level) in refs:
            raise TransformError(f"reference '{target}' leads back to itself at the same place")
        if any(seen == id(schema) for seen, _ in refs) and at.loose and at.level > self._nesting():
            return  # no row has a value so deep
        yield from self.checks(at, schema, "$ref", (*refs, (id(schema), at.level)))

    def _find(self, target: str) -> Any:
        base = self.root.get("$id") if isinstance(self.root, Mapping) else None
        if base and target.startswith(base):
            target = target[len(base) :] or "#"
        if not target.startswith("#"):
            raise TransformError(f"reference '{target}' leaves the schema")
        if target == "#":
            return self.root
        if not target.startswith("#/"):
            for found in _anchored(self.root, target[1:]):
                return found
            raise TransformError(f"reference '{target}' leads nowhere")
        node = self.root
        for part in target[2:].split("/"):
            part = part.replace("~1", "/").replace("~0", "~")
            try:
                node = node[int(part)] if isinstance(node, list) else node[part]
            except (KeyError, IndexError, ValueError, TypeError):
                raise TransformError(f"reference '{target}' leads nowhere") from None
        return node

    def _nesting(self) -> int:
        """How deep the values are nested: one pass over them, only for recursive schemas over VARIANT."""
        if self.deepest is None:
            shown = F.to_json(F.struct(self.value.alias("v")))
            bare = F.regexp_replace(F.regexp_replace(shown, r"\\.", ""), r'"[^"]*"', "")
            marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
            start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

            def follow(seen: Column, mark: Column) -> Column:
                now = seen["now"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
                return F.struct(now.alias("now"), F.greatest(seen["most"], now).alias("most"))

            depth = F.aggregate(marks, start, follow)["most"]
            self.deepest = self.df.agg(F.max(depth).alias("d")).first()["d"] or 0
        return self.deepest

    # objects

    def _properties(self, at, schema, expected, refs):
        if at.is_a("object") is False:
            return
        for name, child in expected.items():
            place = at.member(name)
            if place is not None:
                yield from self.checks(place, child, name, refs)

    def _required(self, at, schema, expected, refs):
        yield from self._names_due(at, expected, "required", None)

    def _names_due(self, at, names, keyword, condition):
        is_object = at.is_a("object")
        if is_object is False:
            return
        for name in names:
            place = at.member(name)
            present = F.lit(False) if place is None else place.value.isNotNull()
            holds = at.value.isNull() | present if is_object is True else at.value.isNull() | ~is_object | present
            check = Check(holds, at.pointer, keyword, f"requires '{name}'")
            yield check if condition is None else check.under(condition)

    def _dependencies(self, at, schema, expected, refs):
        if at.is_a("object") is False:
            return
        for name, due in expected.items():
            place = at.member(name)
            if place is None:
                continue
            given = place.value.isNotNull()
            if isinstance(due, list):
                yield from self._names_due(at, due, "dependentRequired", given)
            else:
                yield from (c.under(given) for c in self.checks(at, due, "dependentSchemas", refs))

    def _members(self, at, wanted: Callable[[Any], Any], child, keyword, refs):
        """``child`` for the members whose name is wanted; ``wanted`` takes a name or a column of names."""
        is_object = at.is_a("object")
        if is_object is False:
            return
        if isinstance(at.dtype, T.StructType):
            for field in at.dtype.fields:
                if (condition := wanted(field.name)) is not False:
                    for check in self.checks(at.member(field.name), child, keyword, refs):
                        yield check if condition is True else check.under(condition)
            return
        members = F.map_filter(at.members()[0], lambda k, _: wanted(k))

        def every():
            held = F.forall(F.map_entries(members), lambda e: self.holds(at.member_at(e["key"], e["value"]), child, refs))
            return F.coalesce(held, F.lit(True))

        def listed():
            found = lambda e: all_violations(
                list(self.checks(at.member_at(e["key"], e["value"]), child, keyword, refs))
            )
            return F.flatten(F.transform(F.map_entries(members), found))

        yield EntryChecks(every, listed)

    def _pattern_properties(self, at, schema, expected, refs):
        for pattern, child in expected.items():
            yield from self._members(at, lambda n, p=pattern: F.lit(n).rlike(p), child, "patternProperties", refs)

    def _additional_properties(self, at, schema, expected, refs):
        named, patterns = list(schema.get("properties", {})), list(schema.get("patternProperties", {}))

        def wanted(name):
            if isinstance(name, str) and name in named:
                return False
            free = F.lit(True) if isinstance(name, str) or not named else ~name.isin(*named)
            for pattern in patterns:
                free = free & ~F.lit(name).rlike(pattern)
            return free

        yield from self._members(at, wanted, expected, "additionalProperties", refs)

    def _property_names(self, at, schema, expected, refs):
        is_object = at.is_a("object")
        if is_object is False:
            return
        ok = F.forall(at.names(), lambda n: self.holds(_Place(n, T.StringType(), ""), expected, refs))
        yield from _of_kind(at, "object", lambda: ok, "propertyNames", expected)

    # arrays

    def _items(self, at, schema, expected, refs):
        if isinstance(expected, list):  # the older form of prefixItems
            yield from self._prefix(at, schema, expected, refs)
        else:
            yield from self._rest(at, len(schema.get("prefixItems", [])), expected, "items", refs)

    def _additional_items(self, at, schema, expected, refs):
        if isinstance(schema.get("items"), list):
            yield from self._rest(at, len(schema["items"]), expected, "additionalItems", refs)

    def _prefix(self, at, schema, expected, refs):
        if at.is_a("array") is False:
            return
        for i, child in enumerate(expected):
            yield from self.checks(at.entry(i), child, "prefixItems", refs)

    def _rest(self, at, start, child, keyword, refs):
        if at.is_a("array") is False:
            return
        values = at.entries()[0]
        rest = F.slice(values, F.lit(start + 1), F.size(values)) if start else values

        def every():
            return F.coalesce(F.forall(rest, lambda x: self.holds(at.entry_at(x, None), child, refs)), F.lit(True))

        def listed():
            found = lambda x, i: all_violations(
                list(self.checks(at.entry_at(x, i + start), child, keyword, refs))
            )
            return F.flatten(F.transform(rest, found))

        yield EntryChecks(every, listed)

    def _contains(self, at, schema, expected, refs):
        if at.is_a("array") is False:
            return
        least, most = schema.get("minContains", 1), schema.get("maxContains")
        fits = lambda x: x.isNotNull() & self.holds(at.entry_at(x, None), expected, refs)
        number = F.size(F.filter(at.entries()[0], fits))
        yield from _of_kind(at, "array", lambda: number >= least, "contains", expected)
        if most is not None:
            yield from _of_kind(at, "array", lambda: number <= most, "maxContains", most)

    # combinations

    def _all_of(self, at, schema, expected, refs):
        for child in _branches("allOf", expected):
            yield from self.checks(at, child, "allOf", refs)

    def _count_of(keyword):  # noqa: N805 - makes the methods of anyOf and oneOf
        def count(self, at, schema, expected, refs):
            held = [self.holds(at, child, refs).cast("int") for child in _branches(keyword, expected)]
            total = held[0]
            for one in held[1:]:
                total = total + one
            holds = total >= 1 if keyword == "anyOf" else total == 1
            yield Check(at.value.isNull() | holds, at.pointer, keyword, f"violates {keyword} {json.dumps(expected)}")

        return count

    def _not(self, at, schema, expected, refs):
        held = self.holds(at, expected, refs)
        yield Check(at.value.isNull() | ~held, at.pointer, "not", f"violates not {json.dumps(expected)}")

    def _if(self, at, schema, expected, refs):
        held = self.holds(at, expected, refs)
        for branch, condition in (("then", held), ("else", ~held)):
            if branch in schema:
                yield from (c.under(condition) for c in self.checks(at, schema[branch], branch, refs))

    any_of, one_of = _count_of("anyOf"), _count_of("oneOf")


def _anchored(node: Any, name: str) -> Iterator[Any]:
    if isinstance(node, Mapping):
        if node.get("$anchor") == name:
            yield node
        for child in node.values():
            yield from _anchored(child, name)
    elif isinstance(node, list):
        for child in node:
            yield from _anchored(child, name)


def _branches(keyword: str, expected: Any) -> list:
    if not isinstance(expected, list) or not expected:
        raise TransformError(f"{keyword} needs at least one schema")
    return expected


def _of_kind(at: _Place, kind: str | None, condition: Callable[[], Any], keyword: str, expected: Any) -> Iterator[Check]:
    """A keyword that only looks at values of one type."""
    fits = True if kind is None else at.is_a(kind)
    if fits is False:
        return
    ok = condition()
    ok = F.lit(ok) if isinstance(ok, bool) else ok
    holds = at.value.isNull() | ok if fits is True else at.value.isNull() | ~fits | F.coalesce(ok, F.lit(False))
    yield Check(holds, at.pointer, keyword, f"violates {keyword} {json.dumps(expected)}")


def _type(at: _Place, expected: Any) -> Column:
    held: Any = F.lit(False)
    for name in expected if isinstance(expected, list) else [expected]:
        if name != "integer" and name not in _SHAPES:
            raise TransformError(f"JSON Schema has no type '{name}'")
        one = at.is_whole() if name == "integer" else at.is_a(name)
        held = held | (F.lit(one) if isinstance(one, bool) else one)
    return held


def _bound(expected: Any) -> float:
    if isinstance(expected, bool) or not isinstance(expected, (int, float)):
        raise TransformError(f"a bound is a number, not {json.dumps(expected)}")
    return float(expected)


def _multiple(at: _Place, expected: Any) -> Column:
    if _bound(expected) <= 0:
        raise TransformError("multipleOf is above zero")
    exact = at.number("decimal(38,18)") % F.lit(_decimal_digits(expected)).cast("decimal(38,18)") == 0
    return F.coalesce(exact, at.number() % F.lit(float(expected)) == 0)


def _among(at: _Place, options: Sequence[Any]) -> Column:
    return F.array_contains(F.array(*[_key_of(o) for o in options]), at.key()) if options else F.lit(False)


def _unique(at: _Place, expected: Any) -> Column:
    if not expected:
        return F.lit(True)
    values = at.entries()[0]
    keys = F.array_compact(F.transform(values, lambda x: at.entry_at(x, None).key()))
    return F.size(F.array_distinct(keys)) == F.size(keys)


# Keywords that look at one value: the type they care about, and their condition.
_SINGLE: dict[str, tuple[str | None, Callable[[_Place, Any], Any]]] = {
    "type": (None, _type),
    "enum": (None, _among),
    "const": (None, lambda at, e: _among(at, [e])),
    "minimum": ("number", lambda at, e: at.number() >= _bound(e)),
    "maximum": ("number", lambda at, e: at.number() <= _bound(e)),
    "exclusiveMinimum": ("number", lambda at, e: at.number() > _bound(e)),
    "exclusiveMaximum": ("number", lambda at, e: at.number() < _bound(e)),
    "multipleOf": ("number", _multiple),
    "minLength": ("string", lambda at, e: F.length(at.text()) >= int(e)),
    "maxLength": ("string", lambda at, e: F.length(at.text()) <= int(e)),
    "pattern": ("string", lambda at, e: at.text().rlike(e)),
    "minItems": ("array", lambda at, e: F.size(at.entries()[0]) >= int(e)),
    "maxItems": ("array", lambda at, e: F.size(at.entries()[0]) <= int(e)),
    "uniqueItems": ("array", _unique),
    "minProperties": ("object", lambda at, e: F.size(at.names()) >= int(e)),
    "maxProperties": ("object", lambda at, e: F.size(at.names()) <= int(e)),
}
# Keywords that hand values on to other schemas.
_COMBINED = {
    "properties": _Compiler._properties,
    "required": _Compiler._required,
    "dependentRequired": _Compiler._dependencies,
    "dependentSchemas": _Compiler._dependencies,
    "dependencies": _Compiler._dependencies,
    "patternProperties": _Compiler._pattern_properties,
    "additionalProperties": _Compiler._additional_properties,
    "propertyNames": _Compiler._property_names,
    "items": _Compiler._items,
    "additionalItems": _Compiler._additional_items,
    "prefixItems": _Compiler._prefix,
    "contains": _Compiler._contains,
    "allOf": _Compiler._all_of,
    "anyOf": _Compiler.any_of,
    "oneOf": _Compiler.one_of,
    "not": _Compiler._not,
    "if": _Compiler._if,
}
