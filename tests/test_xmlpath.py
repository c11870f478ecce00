"""XPath over XML text: literal cases, and random documents against ElementTree."""

import json
import random
from collections import Counter
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftframe.expressions import TransformError
from weftframe.functions import xmlpath, xmltext

SHOP = (
    "<?xml version='1.0'?><!-- <old/> --><s:shop xmlns:s='urn:s'><item id='1'><name>a</name><price>5</price></item>"
    "<item id='02'><name>b</name><price>20</price><note/></item><box><item id='3'><name>c</name></item></box></s:shop>"
)


def query(spark, xml, path, **options):
    df = spark.createDataFrame([(xml,)], "x string")
    row = df.select(xmlpath.xml_query(F.col("x"), path, **options).alias("q")).select(F.to_json("q.result"), "q.matchCount").first()
    return (None if row[0] is None else json.loads(row[0])), row[1]


@pytest.mark.parametrize(
    "path, result, count",
    [
        ("//item/name", ["c", "a", "b"], 3),  # names of one parent in order, parents by name
        ("/shop/item/name", ["a", "b"], 2),
        ("/shop/box", {"item": {"@id": "3", "name": "c"}}, 1),
        ("shop/box/item/name", "c", 1),
        ("/shop/item[2]", {"@id": "02", "name": "b", "price": "20", "note": None}, 1),
        ("/shop/item[last()]/name", "b", 1),
        ("/shop/item[position() < 2]/name", "a", 1),
        ("//item[@id='02']/price", "20", 1),
        ("//item[@id = 2]/price", "20", 1),
        ("//item[price > 10]/name", "b", 1),
        ("//item[10 > price]/name", "a", 1),
        ("//item[not(price)]/name", "c", 1),
        ("//item[note and price = '20']/name", "b", 1),
        ("//item[name = 'a' or name = 'c'][price]/name", "a", 1),
        ("//item[contains(name, 'b')]/@x/..", None, None),
        ("//name[starts-with(., 'c')]", "c", 1),
        ("//name[text() = 'b']", "b", 1),
        ("//item[count(name) = 1][string-length(@id) = 2]/name", "b", 1),
        ("/shop/*[1]/@id", None, None),
        ("//note", None, 1),
        ("/shop/item/name | //price[. = 5]", ["a", "5", "b"], 3),
        ("/other", [], 0),
        ("//missing", [], 0),
        ("//item//name[1]", ["c", "a", "b"], 3),
        (".//box//name", "c", 1),
    ],
)
def test_paths(spark, path, result, count):
    if count is None:
        with pytest.raises(TransformError):
            query(spark, SHOP, path)
        return
    assert query(spark, SHOP, path) == (result, count)


def test_texts_stay_texts(spark):
    xml = "<r a=' 007 ' b=\"1>2 = '3'\"><n>1.50</n><t>true</t><e/><f></f><g> </g><h k='1'> </h><i k='1'>x<!-- c -->y</i><c><![CDATA[<x>&]]> z</c><m>one <b>two</b> three]></m></r>"
    want = {"@a": " 007 ", "@b": "1>2 = '3'", "n": "1.50", "t": "true", "e": None, "f": "", "g": "", "h": {"@k": "1"}, "i": {"@k": "1", "#text": "xy"}, "c": "<x>& z", "m": {"b": "two"}}
    assert query(spark, xml.replace("three]>", "three]&gt; \\ &quot;q&quot; {"), "/r") == (want, 1)
    assert query(spark, "<r>0012</r>", "/r") == ("0012", 1)
    assert query(spark, None, "/r") == (None, None)


def test_errors(spark):
    with pytest.raises(PySparkException, match="matched nothing"):
        query(spark, SHOP, "//none", required=True)
    assert query(spark, SHOP, "//name", required=True)[1] == 3
    for broken in ("<a><b></a>", "<bad", ""):
        with pytest.raises((PySparkException, Py4JJavaError)):
            query(spark, broken, "/a")
        assert query(spark, broken, "/a", on_error="null") == (None, None)
    doctype = '<!DOCTYPE r [<!ENTITY e SYSTEM "file:///etc/passwd">]><r>&e;</r>'
    with pytest.raises(PySparkException, match="document type"):
        query(spark, doctype, "/r")
    assert query(spark, doctype, "/r", on_error="null") == (None, None)
    for path in ("//a[", "a/following::b", "id('x')", "a]", "/", "//a/text()", "a[b $ c]"):
        with pytest.raises(TransformError):
            xmlpath.xml_elements(F.lit("<a/>"), path)


def test_records_as_input(spark):
    df = spark.sql("select named_struct('@id', 7, 'tag', array('x', 'y')) as r")
    row = df.select(xmlpath.record_query(F.col("r"), "/doc/tag[2]", root="doc").alias("q")).select(F.to_json("q.result"), "q.matchCount").first()
    assert tuple(row) == ('"y"', 1)


def test_no_python_in_the_plan(spark):
    df = spark.range(3).select(F.concat(F.lit("<a><b>"), "id", F.lit("</b></a>")).alias("x"))
    plan = df.select(xmlpath.xml_query(F.col("x"), "//b[. > 1]").alias("q"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def random_xml(r, depth=0):
    name = r.choice("abc")
    attributes = "".join(f" {k}={quoteattr(r.choice(['1', '02', 'x y', '<&']))}" for k in "pq" if r.random() < 0.3)
    if depth > 4 or r.random() < 0.35:
        text = r.choice(["", "1", "007", "tr ue", "a]b>", '"&<\\'])
        return f"<{name}{attributes}>{escape(text)}</{name}>" if text else f"<{name}{attributes}/>"
    gap = r.choice(["", "\n  "])
    return f"<{name}{attributes}>" + "".join(gap + random_xml(r, depth + 1) for _ in range(r.randint(1, 4))) + f"</{name}>"


def sorted_json(value):
    return json.dumps(value, sort_keys=True)


def test_random_documents_against_elementtree(spark):
    r = random.Random(11)
    texts = [random_xml(r) for _ in range(150)]
    paths = ["./a", ".//b", "./a/b", "./*", ".//a/c", "./a[2]", ".//b[1]", ".//c[last()]", "./*[@p='02']", ".//a[@q]", ".//a[b]", ".//*[@p='x y']", ".//a//b", "./b/*/a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    for low in range(0, len(paths), 5):
        part = paths[low : low + 5]
        rows = df.select("i", *[xmltext.xml_nodes(F.col("x"), p).alias(f"p{n}") for n, p in enumerate(part)]).collect()
        for row in rows:
            root = ElementTree.fromstring(texts[row["i"]])
            for n, path in enumerate(part):
                once = {id(e): e for e in root.findall(path)}  # it finds some elements twice
                want = Counter(sorted_json(xmltext.element_value(e)) for e in once.values())
                assert Counter(sorted_json(json.loads(v)) for v in row[f"p{n}"]) == want, (path, texts[row["i"]])


def test_text_is_vetted_and_named_once_for_all_paths(spark):
    df = spark.createDataFrame([("<a><b>1</b></a>",), (None,)], "x string")
    q = xmlpath.xml_queries(F.col("x"), {"p": "/a", "q": "//b", "r": "/a/b[1]"})
    plan = df.select(q.alias("q"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("document type declaration is refused") == 1 and text.count("regexp_extract(") == 1
    assert [r[0] and (r[0]["p"]["matchCount"], r[0]["q"]["matchCount"], r[0]["r"]["matchCount"]) for r in plan.collect()] == [(1, 1, 1), (None, None, None)]
