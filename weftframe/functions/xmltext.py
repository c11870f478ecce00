"""XML held in text columns."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How attributes and text appear as fields.
XML_OPTIONS = {"attributePrefix": "@", "valueTag": "#text", "inferSchema": "false"}


def refuse_doctype(xml: Column, on_error: str = "fail") -> Column:
    """The XML itself; a document type declaration is refused (or made null)."""
    declared = xml.rlike("(?i)<!DOCTYPE")
    if on_error == "null":
        return F.when(~declared, xml)
    refusal = F.raise_error(F.lit("XML with a document type declaration is refused")).cast("string")
    return F.when(declared, refusal).otherwise(xml)


def xml_path(xml: Column, path: str, required: bool = False, on_error: str = "fail") -> Column:
    """Text of every text or attribute node at an XPath, as an array; of elements, their own text.

    ``xmlpath.xml_query`` gives elements as records.
    """
    last = re.sub(r"\[[^\]]*\]", "", path).rsplit("/", 1)[-1]
    steps = path if last == "text()" or last.startswith("@") else f"{path}/text()"
    found = F.xpath(refuse_doctype(xml, on_error), F.lit(steps))
    if not required:
        return found
    missing = F.raise_error(F.lit(f"XPath '{path}' matched nothing")).cast("array<string>")
    return F.when(F.size(found) == 0, missing).otherwise(found)


def xml_record(xml: Column, schema: T.StructType | str, on_error: str = "fail") -> Column:
    """XML text to a struct; attributes are ``@name``, mixed text is ``#text``."""
    mode = "FAILFAST" if on_error == "fail" else "PERMISSIVE"
    return F.from_xml(refuse_doctype(xml, on_error), schema, {**XML_OPTIONS, "mode": mode})


def record_xml(record: Column, root: str = "root") -> Column:
    """A struct to XML text on one line."""
    return F.rtrim(F.to_xml(record, {**XML_OPTIONS, "rowTag": root, "indent": ""}), F.lit("\n"))


# --- documents of any shape; Spark calls these on Arrow batches --------------


_dump = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def element_value(element: ElementTree.Element) -> Any:
    """An element as text, null or a dict: attributes are ``@name``, text beside
    attributes is ``#text``, repeated children are lists."""
    children = list(element)
    if not children and not element.attrib:
        return element.text
    record: dict[str, Any] = {f"@{_local(k)}": v for k, v in element.attrib.items()}
    if not children and element.text:
        record["#text"] = element.text
    grouped: dict[str, list[Any]] = {}
    for child in children:
        grouped.setdefault(_local(child.tag), []).append(element_value(child))
    record.update({k: v[0] if len(v) == 1 else v for k, v in grouped.items()})
    return record


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def element_text(name: str, value: Any) -> Iterator[str]:
    """The reverse of :func:`element_value`, as pieces of XML text."""
    if not isinstance(value, dict):
        text = "" if value is None else _scalar(value)
        yield f"<{name}>{escape(text)}</{name}>" if text else f"<{name} />"
        return
    attributes = "".join(f" {k[1:]}={quoteattr(_scalar(v))}" for k, v in value.items() if k.startswith("@"))
    yield f"<{name}{attributes}>"
    for key, child in value.items():
        if key == "#text":
            yield escape(_scalar(child))
        elif not key.startswith("@"):
            for item in child if isinstance(child, list) else [child]:
                yield from element_text(key, item)
    yield f"</{name}>"


def _scalar(value: Any) -> str:
    if isinstance(value, str):
        return value
    return "" if value is None else json.dumps(value)


@F.pandas_udf(T.StringType())
def _xml_to_json(xml: pd.Series) -> pd.Series:
    def convert(text):
        if text is None:
            return None
        return _dump(element_value(ElementTree.fromstring(text)))

    return xml.map(convert)


def xml_json(xml: Column) -> Column:
    """XML of any shape to JSON text (see :func:`element_value`)."""
    return _xml_to_json(refuse_doctype(xml))


def json_xml(document: Column, root: str = "root") -> Column:
    """JSON text to XML text below a root element."""

    @F.pandas_udf("string")
    def convert(text: pd.Series) -> pd.Series:
        return text.map(lambda d: None if d is None else "".join(element_text(root, json.loads(d))))

    return convert(document)


def xml_nodes(xml: Column, path: str) -> Column:
    """See :func:`weftframe.functions.xmlpath.xml_nodes`."""
    from weftframe.functions import xmlpath

    return xmlpath.xml_nodes(xml, path)
