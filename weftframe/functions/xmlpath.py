"""XPath over XML text: matched elements as VARIANT records, in Spark expressions.

The text is parsed once into a VARIANT; the steps of a path become higher-order
expressions over arrays of nodes. Nothing runs in Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftframe.expressions import TransformError
from weftframe.functions.xmltext import XML_OPTIONS, record_xml, refuse_doctype

# Two code points that Unicode keeps out of interchanged text. They stand
# before element texts and attribute values while parsing, so that "007" stays a text.
_TEXT, _VALUE = "﷐", "﷑"
_OPTIONS = {**XML_OPTIONS, "ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_ASIDE = r"(?s)(<!\[CDATA\[.*?\]\]>)|<!--.*?-->|<\?.*?\?>"


def xml_variant(xml: Column, on_error: str = "fail") -> Column:
    """The root element's content as VARIANT: texts stay texts, attributes are ``@name``.

    An element without attributes and children is its text, null if self-closed; text
    beside attributes is ``#text`` (left out if blank); repeated children are arrays;
    text between children is left out. White space alone is no text. Keys are sorted.
    XML that is not well formed is an error, or null with ``on_error='null'``. The code
    points U+FDD0 and U+FDD1, not meant for interchange, are lost.
    """
    plain = F.trim(F.regexp_replace(refuse_doctype(xml, on_error), _ASIDE, "$1"))
    marked = F.regexp_replace(plain, r"=\s*[\"']", "$0" + _VALUE)
    marked = F.regexp_replace(marked, ">(?=[^<]*<)", ">" + _TEXT)
    if on_error == "null":
        refused = F.from_xml(plain, "_refused string", {"columnNameOfCorruptRecord": "_refused"})["_refused"]
        marked = F.when((F.length(plain) > 0) & refused.isNull(), marked)
    # within a lambda: Spark cannot compile this function to a VARIANT
    parsed = F.transform(F.array(marked), lambda x: F.when(x.isNotNull(), F.from_xml(x, F.lit("variant"), _OPTIONS)))[0]
    text = F.to_json(parsed)
    # text around children, then blank texts
    text = F.regexp_replace(text, rf'\{{"#text":\[(?:{_STRING},?)*+\],?', "{")
    text = F.regexp_replace(text, rf'\{{"#text":"{_TEXT}(?:\s|\\[nrt])*+",?', "{")
    text = F.regexp_replace(text, rf'"{_TEXT}(?:\s|\\[nrt])*+"', '""')
    return F.parse_json(F.translate(text, _TEXT + _VALUE, ""))


def root_name(xml: Column) -> Column:
    """Name of the root element, without a prefix."""
    plain = F.regexp_replace(xml, _ASIDE, "$1")
    return F.regexp_extract(plain, r"^\s*<(?:[^\s/>:]+:)?([^\s/>:]+)", 1)


# --- reading a path ----------------------------------------------------------------

_TOKEN = re.compile(
    r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>'[^']*'|\"[^\"]*\")|(?P<mark>//|\.\.|::|!=|<=|>=|[/\[\]().@*=<>,|])"
    r"|(?P<name>[^\W\d][\w.-]*))"
)
_FUNCTIONS = ("not", "contains", "starts-with", "last", "position", "count", "text", "string-length", "normalize-space", "number", "string")


@dataclass
class Step:
    """One step: its name (``*`` any), whether it starts at all descendants, and its predicates."""

    name: str
    deep: bool
    predicates: list[tuple] = field(default_factory=list)


@dataclass
class Path:
    """Steps to elements, and what is taken of them at the end: None, ``text()`` or ``@name``."""

    steps: list[Step]
    last: str | None = None
    absolute: bool = False


class _Reader:
    def __init__(self, path: str):
        self.path = path
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while path[at:].strip():
            found = _TOKEN.match(path, at)
            if not found:
                raise TransformError(f"XPath '{path}': cannot read '{path[at:]}'")
            self.tokens.append((str(found.lastgroup), found.group(str(found.lastgroup))))
            at = found.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str | None:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else None

    def kind(self) -> str | None:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if token is None or (wanted is not None and token != wanted):
            raise TransformError(f"XPath '{self.path}': expected {wanted or 'more'} before '{token or 'its end'}'")
        self.at += 1
        return token

    def union(self) -> list[Path]:
        paths = [self.read()]
        while self.peek() == "|":
            self.take()
            paths.append(self.read())
        if self.peek() is not None:
            raise TransformError(f"XPath '{self.path}': '{self.peek()}' is not known here")
        return paths

    def read(self) -> Path:
        path = Path([], absolute=self.peek() in ("/", "//"))
        deep = self.peek() == "//"
        if path.absolute:
            self.take()
        while True:
            if self.peek() == ".":
                self.take()
            elif self.peek() == "@":
                self.take()
                path.last = "@" + self.take()
            elif self.peek() == "text" and self.peek(1) == "(":
                self.at += 2
                self.take(")")
                path.last = "text()"
            else:
                path.steps.append(self.step(deep))
            if self.peek() not in ("/", "//") or path.last:
                return path
            deep = self.take() == "//"

    def step(self, deep: bool) -> Step:
        if self.peek() != "*" and self.kind() != "name":
            raise TransformError(f"XPath '{self.path}': '{self.peek()}' is not known here")
        name = self.take()
        if self.peek() == "::":
            if name != "child":
                raise TransformError(f"XPath '{self.path}': axis '{name}' is not known")
            self.take()
            name = self.take()
        step = Step(name, deep)
        while self.peek() == "[":
            self.take()
            step.predicates.append(self.either())
            self.take("]")
        return step

    def either(self) -> tuple:
        left = self.both()
        while self.peek() == "or":
            self.take()
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.compared()
        while self.peek() == "and":
            self.take()
            left = ("and", left, self.compared())
        return left

    def compared(self) -> tuple:
        left = self.operand()
        if self.peek() in ("=", "!=", "<", "<=", ">", ">="):
            return ("compare", self.take(), left, self.operand())
        return left

    def operand(self) -> tuple:
        if self.kind() == "number":
            return ("number", float(self.take()))
        if self.kind() == "string":
            return ("text", self.take()[1:-1])
        if self.peek() == "(":
            self.take()
            inner = self.either()
            self.take(")")
            return inner
        if self.kind() == "name" and self.peek(1) == "(" and self.peek() != "text":
            name = self.take()
            if name not in _FUNCTIONS:
                raise TransformError(f"XPath '{self.path}': function '{name}' is not known")
            self.take("(")
            arguments = []
            while self.peek() != ")":
                arguments.append(self.either())
                if self.peek() == ",":
                    self.take()
            self.take(")")
            return (name, *arguments)
        path = self.read()
        if path.absolute:
            raise TransformError(f"XPath '{self.path}': paths in predicates start at the element")
        return ("path", path)


# --- a path as expressions -----------------------------------------------------------

_MAP, _LIST = "map<string,variant>", "array<variant>"


def _node(name: Column, at: Column, value: Column) -> Column:
    return F.struct(name.alias("name"), at.alias("at"), value.alias("value"))


def _children(node: Column, name: str) -> Column:
    """Child elements of a node, in the order of names and then of the document."""
    fields = F.map_entries(F.coalesce(F.try_variant_get(node["value"], "$", _MAP), F.expr(f"cast(map() as {_MAP})")))
    if name == "*":
        wanted = F.filter(fields, lambda e: ~e["key"].startswith("@") & (e["key"] != "#text"))
    else:
        wanted = F.filter(fields, lambda e: e["key"] == name)
    none = F.expr("parse_json('null')")
    # a map holds SQL nulls where the VARIANT holds its own
    listed = F.transform(
        wanted,
        lambda e: F.transform(
            F.coalesce(F.try_variant_get(e["value"], "$", _LIST), F.array(e["value"])),
            lambda v, i: _node(e["key"], F.concat(node["at"], e["key"], F.lit("\x01"), F.lpad(F.hex(i), 8, "0"), F.lit("\x02")), F.coalesce(v, none)),
        ),
    )
    return F.flatten(listed)


def _descendants(nodes: Column, steps: Column) -> Column:
    """The nodes and all elements below them, level by level; ``steps`` is no less than the depth."""
    start = F.struct(nodes.alias("found"), nodes.alias("last"))

    def down(state, _):
        below = F.flatten(F.transform(state["last"], lambda n: _children(n, "*")))
        return F.when(F.size(state["last"]) == 0, state).otherwise(
            F.transform(F.array(below), lambda b: F.struct(F.concat(state["found"], b).alias("found"), b.alias("last")))[0]
        )

    return F.aggregate(F.sequence(F.lit(1), steps), start, down)["found"]


def _in_order(nodes: Column) -> Column:
    """The nodes by their place, each once."""
    by_place = lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)
    once = lambda all_: F.filter(all_, lambda n, i: (i == 0) | (n["at"] != F.get(all_, i - 1)["at"]))
    return F.transform(F.array(F.array_sort(nodes, by_place)), once)[0]


def _text_of(value: Column) -> Column:
    """Text of an element without child elements; null of others."""
    scalar = F.try_variant_get(value, "$", "string")
    fields = F.try_variant_get(value, "$", _MAP)
    childless = F.forall(F.map_keys(fields), lambda k: k.startswith("@") | (k == "#text"))
    beside = F.coalesce(F.try_variant_get(value, "$.#text", "string"), F.lit(""))
    return F.when(fields.isNull(), F.coalesce(scalar, F.lit(""))).when(childless, beside)


class _Compiler:
    def __init__(self, depth: Column):
        self.depth = depth

    def walk(self, nodes: Column, steps: list[Step]) -> Column:
        for step in steps:
            if step.deep:
                nodes = _in_order(_descendants(nodes, self.depth))
            nodes = F.flatten(F.transform(nodes, self.step(step)))
        return nodes

    def step(self, step: Step) -> Callable[[Column], Column]:
        def children(node: Column) -> Column:
            found = _children(node, step.name)
            for predicate in step.predicates:
                # bound once, as positions and the count refer to what came before
                found = F.transform(F.array(found), lambda all_: F.filter(all_, lambda n, i: self.holds(predicate, n, i + 1, F.size(all_))))[0]  # noqa: B023
            return found

        return children

    def holds(self, p: tuple, node: Column, place: Column, size: Column) -> Column:
        if p[0] == "number":
            return place == F.lit(p[1])
        if p[0] in ("or", "and"):
            left, right = self.holds(p[1], node, place, size), self.holds(p[2], node, place, size)
            return left | right if p[0] == "or" else left & right
        if p[0] == "not":
            return ~self.holds(p[1], node, place, size)
        if p[0] in ("contains", "starts-with"):
            a, b = (self.one_text(x, node, place, size) for x in p[1:])
            return F.coalesce(a.contains(b) if p[0] == "contains" else a.startswith(b), F.lit(False))
        if p[0] == "compare":
            return self.compare(p[1], p[2], p[3], node, place, size)
        if p[0] == "path":
            return F.size(self.items(p[1], node)) > 0
        if p[0] in ("last", "position", "count", "string-length", "number"):
            value = self.number(p, node, place, size)
            return place == value if p[0] == "last" else F.coalesce(value, F.lit(0)) != 0
        return F.length(self.one_text(p, node, place, size)) > 0

    def items(self, path: Path, node: Column) -> Column:
        """What a relative path finds: nodes, or texts at an end like ``@a``."""
        nodes = self.walk(F.array(node), path.steps)
        if path.last is None:
            return nodes
        if path.last == "text()":
            return F.filter(F.transform(nodes, lambda n: _text_of(n["value"])), lambda t: F.length(t) > 0)
        key = path.last[1:]
        found = F.transform(nodes, lambda n: F.element_at(F.try_variant_get(n["value"], "$", _MAP), F.lit("@" + key)))
        return F.filter(F.transform(found, lambda v: F.try_variant_get(v, "$", "string")), lambda t: t.isNotNull())

    def texts(self, path: Path, node: Column) -> Column:
        items = self.items(path, node)
        return items if path.last else F.transform(items, lambda n: _text_of(n["value"]))

    def number(self, p: tuple, node: Column, place: Column, size: Column) -> Column:
        if p[0] == "number" and isinstance(p[1], float):
            return F.lit(p[1])
        if p[0] == "last":
            return size.cast("double")
        if p[0] == "position":
            return place.cast("double")
        if p[0] == "count":
            return F.size(self.items(p[1][1], node)).cast("double")
        if p[0] == "string-length":
            return F.length(self.one_text(p[1], node, place, size)).cast("double")
        if p[0] == "number":
            p = p[1]
        return self.one_text(p, node, place, size).try_cast("double")

    def one_text(self, p: tuple, node: Column, place: Column, size: Column) -> Column:
        if p[0] == "text":
            return F.lit(p[1])
        if p[0] == "path":
            return F.coalesce(F.get(self.texts(p[1], node), F.lit(0)), F.lit(""))
        if p[0] == "normalize-space":
            return F.trim(F.regexp_replace(self.one_text(p[1] if len(p) > 1 else ("path", Path([])), node, place, size), r"\s+", " "))
        if p[0] == "string":
            return self.one_text(p[1] if len(p) > 1 else ("path", Path([])), node, place, size)
        return self.number(p, node, place, size).cast("string")

    def compare(self, op: str, a: tuple, b: tuple, node: Column, place: Column, size: Column) -> Column:
        """True if any text of a path compares so; as numbers where one side is one or the order counts."""
        numeric = op not in ("=", "!=") or any(x[0] in ("number", "last", "position", "count", "string-length") for x in (a, b))

        def values(x: tuple) -> Column:
            texts = self.texts(x[1], node) if x[0] == "path" else None
            if not numeric:
                return texts if texts is not None else F.array(self.one_text(x, node, place, size))
            if texts is not None:
                return F.transform(texts, lambda t: F.trim(t).try_cast("double"))
            return F.array(self.number(x, node, place, size))

        kinds = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
        right = values(b)
        return F.exists(values(a), lambda x: F.coalesce(F.exists(right, lambda y: F.coalesce(getattr(x, kinds[op])(y), F.lit(False))), F.lit(False)))


def _document(xml: Column, on_error: str) -> Column:
    """Array of the parsed text, its root's name and a bound on its depth, for a lambda to bind them once."""
    # no element lies deeper than there are closing marks
    depth = F.length(xml) - F.length(F.replace(xml, F.lit("</"), F.lit("<"))) + 1
    return F.array(F.struct(xml_variant(xml, on_error).alias("value"), root_name(xml).alias("name"), depth.alias("depth")))


def _finder(path: str, from_root: bool) -> Callable[[Column], Column]:
    """From an entry of ``_document`` to the array of elements at a path."""
    paths = _Reader(path).union()
    if any(p.last or not p.steps for p in paths):
        raise TransformError(f"XPath '{path}' does not select elements")

    def at_root(step: Step, root: Column, compiler: _Compiler) -> Column:
        own = F.array(root) if step.name == "*" else F.filter(F.array(root), lambda n: n["name"] == step.name)
        for predicate in step.predicates:
            own = F.filter(own, lambda n, i: compiler.holds(predicate, n, i + 1, F.lit(1)))  # noqa: B023
        return own

    def found(document: Column) -> Column:
        value, depth = document["value"], document["depth"]
        compiler = _Compiler(depth)
        root = _node(document["name"], F.lit("/"), value)
        parts = []
        for p in paths:
            if from_root and not p.absolute:
                parts.append(compiler.walk(F.array(root), p.steps))
                continue
            # the document's only child is the root element
            first, *rest = p.steps
            start = at_root(first, root, compiler)
            if first.deep:
                # put in order at the end
                below = F.transform(_descendants(F.array(root), depth), compiler.step(first))
                start = F.concat(start, F.flatten(below))
            parts.append(compiler.walk(start, rest))
        nodes = F.concat(*parts) if len(parts) > 1 else parts[0]
        if len(paths) > 1 or any(step.deep for p in paths for step in p.steps):
            nodes = _in_order(nodes)
        return F.when(value.isNotNull(), F.transform(nodes, lambda n: n["value"]))

    return found


def xml_elements(xml: Column, path: str, on_error: str = "fail", from_root: bool = False) -> Column:
    """Array of the elements (VARIANT, as ``xml_variant`` gives them) that an XPath finds; null of a null text.

    Paths: absolute or from the document (``from_root``: from the root element), ``/`` and ``//``, names, ``*``, ``.``, unions with ``|``
    and predicates with positions, ``last()``, ``position()``, ``count()``, ``@name``, ``text()``,
    relative paths, ``= != < <= > >=``, ``and or not()``, ``contains()``, ``starts-with()``,
    ``string-length()``, ``normalize-space()``, ``number()``, ``string()``. Names match without
    prefixes. Elements of one name come in the order of the document; of different names, by
    name. An element with child elements has no text of its own in predicates. Anything else,
    and a path that ends in a text or an attribute, is an error when the expression is built.
    """
    return F.transform(_document(xml, on_error), _finder(path, from_root))[0]


def xml_queries(xml: Column, paths: dict[str, str], required: bool = False, on_error: str = "fail") -> Column:
    """Struct with ``result`` (VARIANT) and ``matchCount`` for each of several XPaths, over one parse.

    One match is the element itself, none or several are an array. With ``required``
    no match is an error. A null text gives nulls. Paths as in ``xml_elements``.
    """
    finders = {name: _finder(path, False) for name, path in paths.items()}

    def shaped(found: Column, path: str) -> Column:
        result = F.when(F.size(found) == 1, found[0]).otherwise(F.to_variant_object(found))
        if required:
            refusal = F.raise_error(F.lit(f"XPath '{path}' matched nothing")).cast("variant")
            result = F.when(F.size(found) == 0, refusal).otherwise(result)
        return F.struct(F.when(found.isNotNull(), result).alias("result"), F.when(found.isNotNull(), F.size(found)).alias("matchCount"))

    def all_of(document: Column) -> Column:
        # each list of elements is bound once
        lists = {name: F.transform(F.array(find(document)), lambda x: shaped(x, paths[name]))[0] for name, find in finders.items()}  # noqa: B023
        return F.struct(*[found.alias(name) for name, found in lists.items()])

    return F.transform(_document(xml, on_error), all_of)[0]


def xml_query(xml: Column, path: str, required: bool = False, on_error: str = "fail") -> Column:
    """Struct of ``result`` and ``matchCount`` for one XPath (see :func:`xml_queries`)."""
    return xml_queries(xml, {"q": path}, required, on_error)["q"]


def record_query(record: Column, path: str, root: str = "root", required: bool = False) -> Column:
    """``xml_query`` over a struct, taken as the XML element ``root``."""
    return xml_query(record_xml(record, root), path, required)


def xml_nodes(xml: Column, path: str) -> Column:
    """Every element at a path from the root element, such as ``./item`` or ``.//item``, as JSON text, in an array."""
    return F.transform(xml_elements(xml, path, from_root=True), lambda v: F.to_json(v))
