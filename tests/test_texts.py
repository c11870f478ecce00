"""Text, date, CSV, JSON and XML functions on literal values."""

import hashlib
import html
import json
import urllib.parse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftframe.expressions import TransformError
from weftframe.functions import csvtext, dates, jsontext, strings, xmltext


def on(spark, text, column):
    df = spark.createDataFrame([(text,)], "s string")
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, column, expected",
    [
        ("straße", strings.upper, "STRAßE"),
        ("ÉA", strings.lower, "éa"),
        ("  a\t", strings.trim, "a"),
        (" a ", strings.trim_start, "a "),
        (" a ", strings.trim_end, " a"),
        ("hello world", lambda c: strings.substring(c, 6), "world"),
        ("hello", lambda c: strings.substring(c, -3, 2), "he"),
        ("hello", lambda c: strings.substring(c, 9, 2), ""),
        ("a-b-c", lambda c: strings.replace(c, "-", "_"), "a_b_c"),
        ("a.b..c", lambda c: strings.split(c, "."), ["a", "b", "", "c"]),
        ("5", lambda c: strings.pad_left(c, 3, "0"), "005"),
        ("12345", lambda c: strings.pad_left(c, 3, "0"), "12345"),
        ("5", lambda c: strings.pad_right(c, 3), "5  "),
        ("hello world", lambda c: strings.truncate(c, 8, "..."), "hello..."),
        ("hello", lambda c: strings.truncate(c, 1, "..."), "..."),
        ("x", lambda c: strings.format_text(c, "<{0}|{item}>"), "<x|x>"),
        ("a1b2", lambda c: strings.regex_replace(c, r"\d", "#"), "a#b#"),
        ("id=42", lambda c: strings.regex_extract(c, r"id=(\d+)", 1), "42"),
        ("none", lambda c: strings.regex_extract(c, r"id=(\d+)", 1), None),
        ("id=42", lambda c: strings.regex_extract(c, r"id=(\d+)", 2), None),
        ("héllo", strings.base64_encode, "aMOpbGxv"),
        ("aMOpbGxv", strings.base64_decode, "héllo"),
        ("a b~*é+", strings.url_encode, "a%20b~%2A%C3%A9%2B"),
        ("a%20b+c", strings.url_decode, "a b+c"),
        ("50%", strings.url_decode, "50%"),
        ("<a href='x'>é\U0001f600&", strings.html_encode, "&lt;a href=&#39;x&#39;&gt;&#233;&#128512;&amp;"),
        ("&copy &#xD800; &#1114112;", strings.html_decode, "&copy &#xD800; &#1114112;"),
        ("100% %4", strings.url_decode, "100% %4"),
        ("&lt;&eacute;&#233;&#x1F600;", strings.html_decode, "<éé\U0001f600"),
        ("abc", strings.hash_text, hashlib.sha256(b"abc").hexdigest()),
        ("abc", lambda c: strings.hash_text(c, "md5"), "900150983cd24fb0d6963f7d28e17f72"),
        ("abc", lambda c: strings.hash_text(c, "sha512"), hashlib.sha512(b"abc").hexdigest()),
        ("abc", lambda c: strings.hash_text(c, "sha1"), hashlib.sha1(b"abc").hexdigest()),
        (None, strings.upper, ""),
    ],
)
def test_text_functions(spark, text, column, expected):
    assert on(spark, text, column("s")) == expected


def test_operations_by_name_and_arrays(spark):
    df = spark.createDataFrame([(["a", None, "b"],)], "xs array<string>")
    row = df.select(
        strings.apply_operation(F.col("xs"), "upper", over_array=True),
        strings.apply_operation(F.col("xs"), "join", separator="-"),
    ).first()
    assert tuple(row) == (["A", "", "B"], "a--b")
    with pytest.raises(TransformError):
        strings.apply_operation(F.col("xs"), "shout")
    with pytest.raises(TransformError):
        strings.hash_text("xs", "crc")


def test_bad_base64(spark):
    with pytest.raises(PySparkException):
        on(spark, "!!!", strings.base64_decode("s"))
    assert on(spark, "!!!", strings.base64_decode("s", on_error="null")) is None


def test_round_trips_of_odd_text(spark):
    texts = ["", "&amp;", "a\r\nb", "ÿ ", "%41+ ", '"q"', "\U0001f600é"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select(
        "s",
        strings.html_decode(strings.html_encode("s")),
        strings.url_decode(strings.url_encode("s")),
        strings.base64_decode(strings.base64_encode("s")),
        strings.url_encode("s"),
    ).collect()
    for row in rows:
        assert tuple(row)[:4] == (row[0],) * 4
        assert row[4] == urllib.parse.quote(row[0], safe="-_.~")


def test_dates(spark):
    assert dates.spark_pattern("yyyy-MM-dd dddd h:mm tt") == "yyyy-MM-dd EEEE h:mm a"
    assert on(spark, "2024-01-02T03:04:05Z", dates.format_datetime(F.col("s"), "dd/MM/yyyy HH:mm")) == "02/01/2024 03:04"
    assert on(spark, "soon", dates.format_datetime(F.col("s"), "dd", on_error="null")) is None
    with pytest.raises(PySparkException, match="not a date: soon"):
        on(spark, "soon", dates.format_datetime(F.col("s"), "dd"))


def test_csv_text(spark):
    text = 'name,note\r\nAda,"a, ""b"""\r\n\r\nKay\n'
    df = spark.createDataFrame([(1, text), (2, "name,note")], "id int, csv string")
    rows = csvtext.parse_csv_text(df, "csv", ["name", "note"]).orderBy("line_no").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "Ada", 'a, "b"'), (1, 1, "Kay", None)]
    bare = csvtext.parse_csv_text(df, "csv", ["column0", "column1"], has_header=False)
    assert bare.where("id = 2").first()["column1"] == "note"


def test_csv_document(spark):
    df = spark.sql("select array(named_struct('a', 1, 'b', 'x,y'), named_struct('a', 2, 'b', null)) as rows")
    both = df.select(csvtext.csv_document(F.col("rows"), ["a", "b"])).first()[0]
    assert both == 'a,b\n1,"x,y"\n2,'
    assert df.select(csvtext.csv_document(F.col("rows"), ["a"], include_header=False)).first()[0] == "1\n2"


ITEMS = '{"user":{"id":"abc"},"items":[{"name":"a","price":5},{"name":"b","price":20},{"name":"c","price":30}],"n":null}'


@pytest.mark.parametrize(
    "path, result, count",
    [
        ("$.user.id", '"abc"', 1),
        ("$.items[*].name", '["a","b","c"]', 3),
        ("$.items[1].price", "20", 1),
        ("$.items[*]", json.dumps(json.loads(ITEMS)["items"], separators=(",", ":")), 3),
        ("$.nope", "[]", 0),
        ("$.n", "null", 1),
    ],
)
def test_json_path(spark, path, result, count):
    df = spark.createDataFrame([(ITEMS,)], "doc string")
    row = jsontext.json_path(df, "doc", path).first()
    assert (row["result"], row["matchCount"]) == (result, count)


def test_json_path_on_text_that_is_no_json(spark):
    df = spark.createDataFrame([("{broken",)], "doc string")
    assert jsontext.json_path(df, "doc", "$.a", on_error="null").first()["matchCount"] == 0
    with pytest.raises(PySparkException):
        jsontext.json_path(df, "doc", "$.a").collect()


def test_capturing_groups():
    assert strings.capturing_groups(r"(a)(?:b)(?<n>c)(?=d)(?<!e)\([(]") == 2


def test_json_path_required(spark):
    df = spark.createDataFrame([(ITEMS,)], "doc string")
    with pytest.raises(PySparkException):
        jsontext.json_path(df, "doc", "$.nope", required=True).collect()


def test_json_filter(spark):
    found = jsontext.json_filter(F.col("s"), "$.items", lambda x: F.try_variant_get(x, "$.price", "int") > 10)
    assert on(spark, ITEMS, F.size(found)) == 2


def test_extraction_maps(spark):
    text = 'key="v1" other=2'
    columns = jsontext.extract_patterns(
        F.col("s"), {"a": '(k)ey="(?<value>[^"]*)"', "b": r"other=\d", "c": "zzz", "d": " "}
    )
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(*columns).first().asDict() == {"a": "v1", "b": "other=2", "c": None, "d": None}
    paths = jsontext.extract_paths(F.lit(ITEMS), {"id": "$.user.id", "names": "$.items[*].name"})
    assert df.select(*paths).first().asDict() == {"id": "abc", "names": '["a","b","c"]'}


def test_json_merge_and_diff(spark):
    a = spark.createDataFrame([(1, '{"a":1,"b":2}'), (2, '{"x":1}')], "id int, doc string")
    b = spark.createDataFrame([(1, '{"b":null,"c":3}'), (3, '{"y":null,"z":{"q":null}}')], "id int, doc string")
    merged = {row["id"]: json.loads(row["doc"]) for row in jsontext.merge_by_key(a, b, "id", "doc").collect()}
    assert merged == {1: {"a": 1, "c": 3}, 2: {"x": 1}, 3: {"z": {}}}
    c = spark.createDataFrame([(1, '{"a":1,"b":99,"c":3}')], "id int, doc string")
    changes = {(r["op"], r["path"], r["value"]) for r in jsontext.diff_by_key(a, c, "id", "doc").collect()}
    assert changes == {("replace", "b", "99"), ("add", "c", "3")}


def test_flatten_and_unflatten(spark):
    df = spark.createDataFrame([(1, '{"user":{"name":"Ada","addr":{"city":"Paris"}},"e":{}}')], "id int, doc string")
    flat = jsontext.flatten_json(df, "doc")
    assert {row["path"] for row in flat.collect()} == {"user.name", "user.addr.city"}
    back = jsontext.unflatten_json(flat, ["id"]).first()["document"]
    assert json.loads(back) == {"user": {"name": "Ada", "addr": {"city": "Paris"}}}
    again = df.select(jsontext.unflatten_map(F.lit('{"a.b":1,"a.c.0":2}')).alias("d")).first()["d"]
    assert json.loads(again) == {"a": {"b": 1, "c": {"0": 2}}}


keys = st.text("abc", min_size=1, max_size=2)
trees = st.recursive(st.integers() | st.booleans() | st.text(max_size=3), lambda t: st.dictionaries(keys, t, min_size=1, max_size=3), max_leaves=8)


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(keys, trees, min_size=1, max_size=3))
def test_nested_undoes_leaves(tree):
    assert jsontext.nested(jsontext.leaves(tree, "/"), "/") == tree


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(keys, trees, max_size=3), st.dictionaries(keys, trees, max_size=3))
def test_changes_are_empty_only_for_equal_documents(a, b):
    assert (list(jsontext.changes(a, b)) == []) == (jsontext._dump(a) == jsontext._dump(b) or a == b)
    assert jsontext.merged(a, b).items() >= {k: v for k, v in b.items() if not isinstance(v, dict)}.items()


def test_xml(spark):
    xml = '<people><person id="7"><name>Ada</name></person><person id="8"><name>Kay &lt;3</name></person></people>'
    assert on(spark, xml, xmltext.xml_path(F.col("s"), "/people/person/name")) == ["Ada", "Kay <3"]
    assert on(spark, xml, xmltext.xml_path(F.col("s"), "//person/@id")) == ["7", "8"]
    person = on(spark, '<person id="7"><name>Ada</name></person>', xmltext.xml_record(F.col("s"), "`@id` string, name string"))
    assert (person["@id"], person["name"]) == ("7", "Ada")
    items = on(spark, "<items><item>a</item><item>b</item></items>", xmltext.xml_record(F.col("s"), "item array<string>"))
    assert items["item"] == ["a", "b"]
    df = spark.sql("select named_struct('@id', 7, 'name', 'A&B') as r")
    assert df.select(xmltext.record_xml(F.col("r"), "person")).first()[0] == '<person id="7"><name>A&amp;B</name></person>'


@pytest.mark.parametrize(
    "xml, expected",
    [
        ('<person id="7"><name>Ada</name></person>', {"@id": "7", "name": "Ada"}),
        ("<items><item>a</item><item>b</item></items>", {"item": ["a", "b"]}),
        ('<a x="1">t</a>', {"@x": "1", "#text": "t"}),
        ("<a><b/></a>", {"b": None}),
        ("<a>t</a>", "t"),
    ],
)
def test_xml_of_any_shape(spark, xml, expected):
    document = on(spark, xml, xmltext.xml_json(F.col("s")))
    assert json.loads(document) == expected
    name = xml[1 : min(xml.index(c) for c in " >" if c in xml)]
    again = on(spark, document, xmltext.xml_json(xmltext.json_xml(F.col("s"), name)))
    assert json.loads(again) == expected


def test_xml_nodes(spark):
    xml = '<r><p id="1"><n>Ada</n></p><p id="2"/></r>'
    found = on(spark, xml, xmltext.xml_nodes(F.col("s"), ".//p"))
    assert [json.loads(f) for f in found] == [{"@id": "1", "n": "Ada"}, {"@id": "2"}]
    assert on(spark, xml, xmltext.xml_nodes(F.col("s"), "./p[@id='3']")) == []


def test_xml_refuses_doctype_and_missing_paths(spark):
    evil = '<!DOCTYPE r [<!ENTITY e SYSTEM "file:///etc/passwd">]><r>&e;</r>'
    with pytest.raises(PySparkException):
        on(spark, evil, xmltext.xml_path(F.col("s"), "/r"))
    assert on(spark, evil, xmltext.xml_path(F.col("s"), "/r", on_error="null")) is None
    with pytest.raises(PySparkException):
        on(spark, "<a/>", xmltext.xml_path(F.col("s"), "/a/b", required=True))


def test_html_decoder_agrees_with_python(spark):
    samples = ["&nbsp;&copy;", "&unknown;", "&#65;&#x41;", "plain", "&amp;lt;", "&apos;"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    assert [r[0] for r in df.select(strings.html_decode("s")).collect()] == [html.unescape(s) for s in samples]


def test_empty_value_groups_and_exact_json_numbers(spark):
    from weftframe.functions import jsontext, xmltext

    df = spark.createDataFrame([("k=;", '{"a":1e999,"b":1}', '{"b":12345678901234567890.123}', "<a><b id='1'>x</b><b>y</b></a>")], "t string, j string, p string, x string")
    assert df.select(*jsontext.extract_patterns(F.col("t"), {"v": "k=(?<value>[^;]*);"})).first()["v"] == ""
    assert jsontext._dump(jsontext.merged(jsontext._load('{"a":1e999,"b":1}'), jsontext._load('{"b":12345678901234567890.123}'))) == '{"a":1e999,"b":12345678901234567890.123}'
    assert df.select(xmltext.xml_path(F.col("x"), "/a/b[@id='1']").alias("v")).first()["v"] == ["x"]
