"""JSON Schema over VARIANT and typed rows: every keyword by literal documents, locations, recursion."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftframe.expressions import TransformError
from weftframe.operators.quality import check_schema
from weftframe.operators.schemas import all_hold, schema_checks

TREE = {"type": "object", "required": ["v"], "properties": {"v": {"type": "integer"}, "next": {"$ref": "#"}}}
# schema, documents that match, documents that do not
CASES = [
    ({"type": "integer"}, [1, 1.0, -7], [1.5, "1", True, None, [], {}]),
    ({"type": ["string", "null"]}, ["", None], [0, False, []]),
    ({"type": "number"}, [1, 1.5, 1e40], ["1", None]),
    ({"const": {"a": [1, 2]}}, [{"a": [1.0, 2]}], [{"a": [2, 1]}, {"a": [1, 2], "b": 0}]),
    ({"enum": [1, "x", None, False]}, [1.0, "x", None, False], ["1", 0, True, "X"]),
    ({"enum": [0.00001, 1e40, 12345678901234567890123, -0.5]}, [1e-5, 1e40, 12345678901234567890123, -0.50], [12345678901234567890124]),
    ({"minimum": 2, "exclusiveMaximum": 5}, [2, 4.9, "text"], [1.9, 5]),
    ({"exclusiveMinimum": 2, "maximum": 5}, [2.1, 5], [2, 5.1]),
    ({"multipleOf": 0.1}, [0.3, 4, "x"], [0.25]),
    ({"minLength": 2, "maxLength": 3}, ["ab", "äöü", "😀😀", 5], ["a", "abcd"]),
    ({"pattern": "b+"}, ["abc", 3], ["ac", ""]),
    ({"minItems": 1, "maxItems": 2}, [[1], [1, 2], "abc"], [[], [1, 2, 3]]),
    ({"uniqueItems": True}, [[], [1, "1"], [[1], [2]], {}], [[1, 1.0], [{"a": 1}, {"a": 1}], ["x", "x"]]),
    ({"uniqueItems": False}, [[1, 1]], []),
    ({"items": {"type": "string"}}, [[], ["a"], 5], [["a", 1], [None]]),
    ({"items": {"items": {"minimum": 0}}}, [[[0], []]], [[[1], [-1]]]),
    ({"prefixItems": [{"type": "string"}], "items": {"type": "number"}}, [["a", 1], [], ["a"]], [[1], ["a", "b"]]),
    ({"items": [{"type": "string"}], "additionalItems": False}, [["a"], []], [["a", 1]]),
    ({"contains": {"minimum": 5}}, [[1, 5], "x"], [[], [1]]),
    ({"contains": {"minimum": 5}, "minContains": 2, "maxContains": 3}, [[5, 6]], [[5], [5, 6, 7, 8]]),
    ({"contains": {"minimum": 5}, "minContains": 0}, [[], [1]], []),
    ({"properties": {"a": {"type": "string"}}, "required": ["a"]}, [{"a": ""}, 3], [{}, {"a": None}, {"b": ""}]),
    ({"properties": {"a.b": {"minimum": 1}, "it's \"": {"minimum": 1}}}, [{"a.b": 1}], [{"a.b": 0}, {"it's \"": 0}]),
    ({"minProperties": 1, "maxProperties": 2}, [{"a": None}, []], [{}, {"a": 1, "b": 2, "c": 3}]),
    ({"propertyNames": {"pattern": "^[a-z]+$"}}, [{"ab": 1}, {}], [{"A": 1}]),
    ({"additionalProperties": False, "properties": {"a": True}}, [{"a": 1}, {}, 1], [{"b": None}]),
    (
        {"properties": {"a": True}, "patternProperties": {"^x": {"type": "number"}}, "additionalProperties": {"type": "string"}},
        [{"a": [], "x1": 2, "q": "s"}],
        [{"x1": "2"}, {"q": 1}],
    ),
    ({"dependentRequired": {"a": ["b"]}}, [{"b": 1}, {"a": 1, "b": None}, {}], [{"a": 1}]),
    ({"dependentSchemas": {"a": {"minProperties": 2}}}, [{"b": 1}, {"a": 1, "b": 1}], [{"a": 1}]),
    ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, [2], [0, 4]),
    ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["a", 3], [2]),
    ({"oneOf": [{"multipleOf": 3}, {"multipleOf": 5}]}, [3, 5], [15, 7]),
    ({"not": {"type": ["string", "array"]}}, [1, None, {}], ["a", []]),
    (
        {"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"required": ["c"]}},
        [{"a": 1, "b": 1}, {"c": 1}],
        [{"a": 1}, {}],
    ),
    ({"$defs": {"p~/": {"minimum": 1}}, "items": {"$ref": "#/$defs/p~0~1"}}, [[1]], [[0]]),
    ({"$defs": {"p": {"$anchor": "here", "minimum": 1}}, "items": {"$ref": "#here"}}, [[1]], [[0]]),
    (TREE, [{"v": 1}, {"v": 1, "next": {"v": 2, "next": {"v": 3}}}], [{"v": 1, "next": {"v": 2, "next": {}}}, {"v": 1, "next": 5}]),
    (True, [1, None], []),
    (False, [], [1, None]),
    ({"format": "email", "title": "t", "x-own": 1}, ["no mail"], []),
]


def documents(spark, docs):
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "n int, j string").select("n", F.parse_json("j").alias("v")).coalesce(1)


def test_keywords_by_documents(spark):
    docs = [d for _, good, bad in CASES for d in (*good, *bad)]
    df = documents(spark, docs)
    columns = [
        all_hold(schema_checks(df, schema, F.col("v"), T.VariantType())).alias(f"s{i}") for i, (schema, _, _) in enumerate(CASES)
    ]
    rows = {r["n"]: r for r in df.select("n", *columns).collect()}
    n = 0
    for i, (schema, good, bad) in enumerate(CASES):
        for document, due in [*((d, True) for d in good), *((d, False) for d in bad)]:
            assert rows[n][f"s{i}"] is due, (schema, document, due)
            n += 1


def test_locations_and_every_error(spark):
    df = documents(spark, [{"a/b": [1, {"x": "y"}, -3], "m": {"k~": "long", "o": 1}, "n": None}])
    schema = {
        "properties": {
            "a/b": {"items": {"type": "number", "minimum": 0}},
            "m": {"additionalProperties": {"type": "string", "maxLength": 2}},
            "n": {"anyOf": [{"type": "string"}, {"type": "number"}]},
        }
    }
    checked = check_schema(df, schema, column="v")
    found = {(r["field"], r["rule"]) for r in checked.errors("n").collect()}
    assert found == {
        ("/a~1b/1", "type"),
        ("/a~1b/2", "minimum"),
        ("/m/k~0", "maxLength"),
        ("/m/o", "type"),
        ("/n", "anyOf"),
    }
    assert checked.valid.count() == 0 and checked.invalid.count() == 1
    assert checked.summary().first().asDict() == {"isValid": False, "validCount": 0, "invalidCount": 1, "errorCount": 5}


def test_typed_rows(spark):
    df = spark.createDataFrame(
        [
            (1, [("a", 2.0), ("b", -1.0)], {"x": 1}, "s"),
            (2, [("c", 3.0), None], {"y": 5}, None),
            (3, None, None, "long text"),
            (4, [], {}, ""),
        ],
        "n int, lines array<struct<name:string,price:double>>, m map<string,int>, s string",
    )
    schema = {
        "properties": {
            "lines": {"items": {"properties": {"price": {"minimum": 0}}, "required": ["name"]}, "minItems": 1},
            "m": {"propertyNames": {"const": "x"}, "additionalProperties": {"maximum": 4}},
            "s": {"not": {"minLength": 5}},
        },
        "required": ["s"],
        "additionalProperties": False,
    }
    checked = check_schema(df, {**schema, "patternProperties": {"^n$": True}})
    found = {(r["n"], r["field"], r["rule"]) for r in checked.errors("n").collect()}
    assert found == {
        (1, "/lines/1/price", "minimum"),
        (2, "/m", "propertyNames"),
        (2, "/m/y", "maximum"),
        (2, "", "required"),
        (3, "/s", "not"),
        (4, "/lines", "minItems"),
    }
    extra = check_schema(df, {"properties": {"n": True, "s": True}, "additionalProperties": False})
    assert {(r["n"], r["field"]) for r in extra.errors("n").collect()} == {
        (1, "/lines"), (1, "/m"), (2, "/lines"), (2, "/m"), (4, "/lines"), (4, "/m")
    }
    assert check_schema(df.limit(0), schema).summary().first()["errorCount"] == 0


def test_recursion_follows_the_data(spark):
    deep = {"v": "wrong"}
    for _ in range(30):
        deep = {"v": 1, "next": deep}
    df = documents(spark, [deep, {"v": 1}])
    found = [(r["n"], r["field"], r["rule"]) for r in check_schema(df, TREE, column="v").errors("n").collect()]
    assert found == [(0, "/next" * 30 + "/v", "type")]


@pytest.mark.parametrize(
    "schema",
    [
        {"oneOf": []},
        {"$ref": "#"},
        {"$ref": "#/$defs/none"},
        {"$ref": "http://elsewhere/x"},
        {"type": "text"},
        {"minimum": "3"},
        {"unevaluatedProperties": False},
    ],
)
def test_refused_schemas(spark, schema):
    with pytest.raises(TransformError):
        check_schema(spark.createDataFrame([(1,)], "n int"), schema, column="n")


def test_plain_bounds_reach_the_scan(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    checked = check_schema(df, {"properties": {"id": {"minimum": 3}}})
    assert checked.valid.count() == 7


def test_errors_evaluate_each_check_once(spark):
    """No filter on the array of errors, which would repeat every check and the column under check."""
    made = F.parse_json(F.concat(F.lit('{"a": '), F.col("id").cast("string"), F.lit("}")))
    df = spark.range(4).select("id", made.alias("v"))
    schema = {"properties": {"a": {"type": "integer", "minimum": 2}, "b": {"type": "string"}}, "required": ["a"]}
    errors = check_schema(df, schema, column="v").errors("id")
    assert {tuple(r) for r in errors.collect()} == {(i, "/a", "minimum", "violates minimum 2") for i in (0, 1)}
    assert errors._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_nested_check_is_spread(spark, small):
    from weftframe.plans import QUERIES

    plan = QUERIES["dq_schema_nested"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.count("parseJson") == 1
