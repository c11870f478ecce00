"""Filter, project, sort, slice, map, route on small literal tables."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftframe.expressions import TransformError, field_path, loose_key, truth
from weftframe.operators import mapping as m
from weftframe.operators import querying as q
from weftframe.operators import routing as r
from weftframe.operators.indexing import with_group_index, with_row_index


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [("Ada", 36, "eng"), ("Grace", 45, "eng"), ("Kay", 28, "sales")], "name string, age long, dept string"
    )


def names(df):
    return [row["name"] for row in df.collect()]


def test_filter(people):
    assert q.filter_rows(people, "item.age > 30").count() == 2


def test_filter_null_predicate(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert q.filter_rows(df, "item.a > 0").count() == 1
    with pytest.raises(PySparkException):
        q.filter_rows(df, "item.a > 0", on_null="fail").collect()


def test_filter_by_index(people):
    assert names(q.filter_rows(people, "index >= 1 and item.age > 30", order_by="age")) == ["Ada", "Grace"]
    with pytest.raises(TransformError):
        q.filter_rows(people, "index >= 1")


def test_sort(people):
    assert names(q.sort_rows(people, "age"))[0] == "Kay"
    assert names(q.sort_rows(people, "age", descending=True))[0] == "Grace"
    assert names(q.sort_rows(people, "item.age * -1"))[0] == "Grace"


def test_sort_numbers_in_text_and_nulls(spark):
    df = spark.createDataFrame([("10",), ("9",), (None,), ("b",)], "name string")
    assert names(q.sort_rows(df, "name"))[0] is None or names(q.sort_rows(df, "name"))[0] == "b"
    ordered = names(q.sort_rows(df.where("name is null or name < 'a'"), "name"))
    assert ordered == [None, "9", "10"]
    assert names(q.sort_rows(df.where("name is null or name < 'a'"), "name", descending=True)) == ["10", "9", None]


def test_skip_take_and_total(people):
    result = q.run_query(people, order_by="age", skip=1, take=1)
    assert result.result.count() == 1
    assert result.total_count().first()["totalCount"] == 3


def test_fixed_order_of_steps(people):
    result = q.run_query(people, where="item.dept = 'eng'", order_by="age", descending=True, take=1, select="item.name")
    assert [row["value"] for row in result.result.collect()] == ["Grace"]


def test_deep_slices_use_the_row_index(spark):
    df = spark.range(0, 30_000, 1, 8).withColumn("k", F.expr("id % 3"))
    deep = q.slice_rows(df, ["k", "id"], 15_000, 5)
    assert sorted(row["id"] for row in deep.collect()) == [15_001, 15_004, 15_007, 15_010, 15_013]
    assert "TakeOrdered" not in deep._jdf.queryExecution().executedPlan().toString()
    assert q.slice_rows(df, ["id"], 29_990).count() == 10


def test_page(people):
    page = q.page_rows(people, ["age"], page=2, page_size=2)
    assert names(page.items) == ["Grace"]
    info = page.info.first()
    assert (info["totalCount"], info["totalPages"], info["hasNext"], info["hasPrevious"]) == (3, 2, False, True)


def test_pages_out_of_range_are_refused(people):
    for page, size in ((0, 10), (1, 0), (1, 500)):
        with pytest.raises(TransformError):
            q.page_rows(people, ["age"], page=page, page_size=size)


def test_loose_keys_are_exact(spark):
    rows = [(2**53, "9007199254740992", 1.0, 10), (2**53 + 1, "9007199254740993.0", 1e20, 10), (1, " 1.50 ", 1.5, 3), (0, "-0", -0.0, 0)]
    df = spark.createDataFrame(rows, "n long, s string, d double, k long")
    types = {f.name: f.dataType for f in df.schema}
    keys = df.select(*[loose_key(F.col(c), types[c]).alias(c) for c in "nsdk"]).collect()
    assert keys[0]["n"] == keys[0]["s"] != keys[1]["n"] == keys[1]["s"]
    assert keys[2]["s"] == keys[2]["d"] and keys[3]["n"] == keys[3]["s"] == keys[3]["d"]
    assert keys[2]["n"] == keys[0]["d"]


def test_row_index_takes_variants_and_leaves_settings_alone(spark):
    setting = "pandas_on_Spark.compute.default_index_cache"
    before = spark.conf.get(setting, None)
    df = spark.range(5).select("id", F.parse_json(F.lit("[1]")).alias("v"))
    assert [r["index"] for r in with_row_index(df, F.desc("id")).orderBy("id").collect()] == [4, 3, 2, 1, 0]
    assert spark.conf.get(setting, None) == before


def test_row_index_is_the_sort_position(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("k", F.expr("pmod(id * 7919, 1000)"))
    wrong = with_row_index(df, "k").where("index <> k").count()
    assert wrong == 0


def test_row_index_in_input_order(spark):
    numbered = with_row_index(spark.range(0, 1000, 1, 7))
    assert numbered.where("index <> id").count() == 0
    assert "rangepartitioning" not in numbered._jdf.queryExecution().executedPlan().toString()


def test_group_index_with_one_hot_key(spark):
    df = spark.range(0, 9000, 1, 8).select(
        F.expr("if(id % 3 = 0, null, if(id % 3 = 1, -1, id))").alias("g"), F.col("id").alias("o")
    )
    found = with_group_index(df, ["g"], ["o"])
    per_group = found.groupBy("g").agg(F.count("*").alias("n"), F.min("index").alias("a"), F.max("index").alias("z"))
    assert per_group.where("a <> 0 or z <> n - 1").count() == 0
    assert found.where("g is null and index <> o / 3").count() == 0


def test_map_paths_defaults_and_conversion(spark):
    df = spark.createDataFrame([("42", {"city": "Paris"}, [1, 2])], "n string, addr struct<city:string>, xs array<int>")
    row = m.map_rows(
        df,
        {
            "city": "addr.city",
            "second": "xs.1",
            "none": "xs.7",
            "n": {"path": "n", "convert": "int"},
            "d": {"path": "addr.zip", "default": "?"},
            "c": {"expression": "case when length(item.n) = 2 then 'two' else 'other' end"},
        },
    ).result.first()
    assert row.asDict() == {"city": "Paris", "second": 2, "none": None, "n": 42, "d": "?", "c": "two"}


def test_map_with_index(people):
    mapped = m.map_rows(people, {"n": "name", "i": {"expression": "index * 10"}}, order_by="age").result
    assert {r["n"]: r["i"] for r in mapped.collect()} == {"Kay": 0, "Ada": 10, "Grace": 20}


def test_convert_failures(spark):
    df = spark.createDataFrame([("42",), ("notanumber",)], "n string")
    spec = {"n": {"path": "n", "convert": "int"}}
    with pytest.raises(PySparkException, match="field 'n': cannot convert 'notanumber' to int"):
        m.map_rows(df, spec).result.collect()
    assert [row["n"] for row in m.map_rows(df, spec, on_error="null").result.collect()] == [42, None]
    split = m.map_rows(df, spec, on_error="quarantine")
    assert split.result.count() == 1
    assert split.rejected.first()["_errors"][0]["field"] == "n"
    with pytest.raises(TransformError):
        m.map_rows(df, {"n": {"path": "n", "convert": "colour"}})


@pytest.mark.parametrize(
    "value, target, expected",
    [
        ("2.5", "double", 2.5),
        ("1d", "double", None),
        ("2.5", "int", None),
        (2.5, "int", 2),
        (3.5, "long", 4),
        ("TRUE", "bool", True),
        ("yes", "bool", None),
        ("{0F8FAD5B-D9CB-469F-A165-70867728950E}", "guid", "0f8fad5b-d9cb-469f-a165-70867728950e"),
        ("x", "guid", None),
        ("2024-01-02T03:04:05", "dateTime", dt.datetime(2024, 1, 2, 3, 4, 5)),
        (7, "string", "7"),
    ],
)
def test_convert_table(spark, value, target, expected):
    df = spark.createDataFrame([(value,)], ["v"])
    got = m.map_rows(df, {"v": {"path": "v", "convert": target}}, on_error="null").result.first()["v"]
    assert got == expected


def test_flatten_and_ignore_nulls(spark):
    df = spark.createDataFrame([(1, ("Ada", ("Paris",)), None)], "id int, user struct<name:string,addr:struct<city:string>>, x int")
    assert m.flatten_fields(df).columns == ["id", "user.name", "user.addr.city", "x"]
    assert m.record_without_nulls(df.select("id", "x")).first()["record"] == '{"id":1}'


def test_paths_into_maps_and_variants(spark):
    df = spark.sql("select map('a', 1) as m, parse_json('{\"b\":[{\"c\":5}]}') as v")
    row = df.select(field_path(df, "m.a"), field_path(df, "m.z"), field_path(df, "v.b.0.c").cast("int")).first()
    assert tuple(row) == (1, None, 5)
    assert field_path(df, "nope.x") is None


def test_route_if_words_and_null(spark):
    df = spark.createDataFrame([("Yes",), ("off",), (" 1 ",)], "f string")
    yes, no = r.route_if(df, "f")
    assert (yes.count(), no.count()) == (2, 1)
    bad = spark.createDataFrame([("maybe",)], "f string")
    with pytest.raises(PySparkException):
        r.route_if(bad, "f")[0].collect()
    assert r.route_if(bad, "f", on_null="false")[1].count() == 1


def test_routes_partition_the_input(people):
    yes, no = r.route_if(people, "item.age > 30")
    assert yes.count() + no.count() == people.count()


def test_switch(people):
    cases = [{"match": "ENG", "port": "a"}, {"match": "sales", "port": "b"}]
    assert {row["port"] for row in r.route_switch(people, "dept", cases).collect()} == {"a", "b"}
    with pytest.raises(PySparkException):
        r.route_switch(people, "dept", cases, case_sensitive=True).collect()
    strict = r.route_switch(people, "dept", cases, default="rest", case_sensitive=True)
    assert strict.where("port = 'rest'").count() == 2
    numbers = r.route_switch(people, "age", [{"match": 36, "port": "x"}], default="y")
    assert numbers.where("port = 'x'").count() == 1


def test_binding(spark, people):
    sql, args = r.bind_variables("age > {{Variable.a.b}}", {"A": {"b": "30"}}, {"a.b": "int"})
    assert (sql, args) == ("age > :p_a_b", {"p_a_b": 30})
    with pytest.raises(TransformError, match="parameter 'x'"):
        r.check_bindable({"x": object()})
    rows = r.run_sql(spark, "select name from {p} where name = :n", {"p": people}, {"n": "x' or '1'='1"})
    assert rows.count() == 0


def test_truth_and_loose_key(spark):
    df = spark.createDataFrame([("1", 1.0, True)], "s string, d double, b boolean")
    types = dict((f.name, f.dataType) for f in df.schema)
    row = df.select(
        loose_key(F.col("s"), types["s"]) == loose_key(F.col("d"), types["d"]),
        loose_key(F.col("b"), types["b"]) == loose_key(F.col("d"), types["d"]),
        truth(F.col("d"), types["d"]),
    ).first()
    assert tuple(row) == (True, False, True)
