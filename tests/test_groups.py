"""Aggregates, joins and branches."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from weftframe.expressions import TransformError
from weftframe.operators import aggregating
from weftframe.operators.aggregating import aggregate
from weftframe.operators.combining import branch_names, concat_branches, merge_branches, with_branch_count
from weftframe.operators.joining import join_tables


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [("Ada", 36, "eng"), ("Grace", 45, "eng"), ("Kay", 28, "sales")], "name string, age long, dept string"
    )


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame([(1, 10), (2, 20), (3, 99)], "id long, customerId long")


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame([(10, "Ada"), (20, "Grace"), (30, "Kay")], "cid long, name string")


def value(df):
    return df.first()["result"]


def test_simple_aggregates(people):
    assert value(aggregate(people, "sum", "age")) == 109
    assert round(value(aggregate(people, "avg", "age")), 2) == 36.33
    assert value(aggregate(people, "min", "age")) == 28
    assert value(aggregate(people, "max", "age")) == 45
    assert value(aggregate(people, "count")) == 3
    assert value(aggregate(people, "median", "age")) == 36
    assert value(aggregate(people, "first", "name", order_by=["age"])) == "Kay"
    assert value(aggregate(people, "last", "name", order_by=["age"])) == "Grace"


def test_distinct_in_first_seen_order(people):
    rows = aggregate(people, "distinct", "dept", order_by=["name"]).orderBy("first_seen").collect()
    assert [row["result"] for row in rows] == ["eng", "sales"]


def test_grouped_sum(people):
    rows = {row["key"]: (row["result"], row["count"]) for row in aggregate(people, "sum", "age", "dept").collect()}
    assert rows["eng"] == (81, 2)


def test_whole_records(people):
    assert value(aggregate(people, "first", order_by=["age"]))["name"] == "Kay"
    twice = people.union(people)
    assert aggregate(twice, "distinct", order_by=["age"]).count() == 3
    with pytest.raises(TransformError):
        aggregate(people, "sum")


def test_empty_input(people):
    nothing = people.where("age > 1000")
    assert value(aggregate(nothing, "sum", "age")) == 0
    for operation in ("avg", "min", "max", "median"):
        assert value(aggregate(nothing, operation, "age")) is None
    assert value(aggregate(nothing, "count")) == 0


def test_text_that_is_no_number_is_skipped(spark):
    df = spark.createDataFrame([("1",), (" 2.5 ",), ("x",), (None,), ("1d",)], "v string")
    assert value(aggregate(df, "sum", "v")) == 3.5
    assert value(aggregate(df, "median", "v")) == 1.75


def test_mode_counts_nulls_and_breaks_ties_by_order(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, None)], "i int, v string")
    assert value(aggregate(df, "mode", "v", order_by=["i"])) == "b"
    more_nulls = df.union(spark.createDataFrame([(6, None), (7, None)], "i int, v string"))
    assert value(aggregate(more_nulls, "mode", "v", order_by=["i"])) is None


def test_order_has_to_be_given(people):
    with pytest.raises(TransformError):
        aggregate(people, "first", "name")


@pytest.mark.parametrize("accuracy", [20, 200])
def test_median_is_exact_with_a_coarse_sketch(spark, monkeypatch, accuracy):
    monkeypatch.setattr(aggregating, "MEDIAN_ACCURACY", accuracy)
    dice = random.Random(5)
    data = [("hot", dice.gauss(0, 1)) for _ in range(20_000)]
    data += [(f"k{i % 50}", float(dice.randint(0, 9))) for i in range(3_000)]
    data += [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None), (None, 3.0)]
    df = spark.createDataFrame(data, "k string, v double").repartition(8)
    expected = {}
    for key, v in data:
        expected.setdefault(key, [])
        if v is not None:
            expected[key].append(v)
    got = {row["key"]: row["result"] for row in aggregate(df, "median", "v", "k").collect()}
    assert got == {k: statistics.median(v) if v else None for k, v in expected.items()}
    everything = [v for _, v in data if v is not None]
    assert value(aggregate(df, "median", "v")) == statistics.median(everything)


def test_joins(orders, customers):
    assert join_tables(orders, customers, "customerId", "cid").result.count() == 2
    left = join_tables(orders, customers, "customerId", "cid", "left")
    assert left.result.count() == 3
    assert left.unmatched().first()["unmatchedLeft"] == 1
    full = join_tables(orders, customers, "customerId", "cid", "full")
    assert full.result.count() == 4
    assert full.unmatched().first()["unmatchedRight"] == 1
    with pytest.raises(TransformError):
        join_tables(orders, customers, "customerId", "cid", "cross")


def test_default_shape_nests_the_right_side(orders, customers):
    rows = {row["id"]: row["right"] for row in join_tables(orders, customers, "customerId", "cid", "full").result.collect()}
    assert rows[1]["name"] == "Ada"
    assert rows[3] is None
    assert rows[None]["name"] == "Kay"


def test_full_join_with_expressions(orders, customers):
    joined = join_tables(
        orders, customers, "customerId", "cid", "full", "concat_ws('-', left.id, right.name)"
    ).result
    assert sorted(row["value"] for row in joined.collect()) == ["1-Ada", "2-Grace", "3", "Kay"]


def test_null_keys_match_and_count_once(spark):
    left = spark.createDataFrame([(None, 1), (5, 2)], "k int, a int")
    right = spark.createDataFrame([(None, 3), (None, 4)], "k int, b int")
    for how, rows in (("inner", 2), ("left", 3), ("full", 3)):
        assert join_tables(left, right, "k", "k", how).result.count() == rows


def test_null_keys_kept_apart(spark):
    left = spark.createDataFrame([(None, 1), (5, 2)], "k int, a int")
    right = spark.createDataFrame([(None, 3), (5, 4)], "k int, b int")
    for how, rows in (("inner", 1), ("left", 2), ("full", 3)):
        joined = join_tables(left, right, "k", "k", how, null_matches_null=False)
        assert joined.result.count() == rows
    counts = joined.unmatched().first()
    assert (counts["unmatchedLeft"], counts["unmatchedRight"]) == (1, 1)


def test_bucketed_tables_meet_without_a_shuffle(spark):
    for name in ("bucket_l", "bucket_r"):
        spark.sql(f"drop table if exists {name}")
        spark.range(1000).withColumn("v", F.col("id") * 2).write.bucketBy(4, "id").saveAsTable(name)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_tables(
            spark.table("bucket_l"), spark.table("bucket_r"), "id", "id", null_matches_null=False, select="left.v"
        ).result
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_loose_keys(spark):
    left = spark.createDataFrame([("1",), ("1.0",), ("x",)], "k string")
    right = spark.createDataFrame([(1,)], "k long")
    assert join_tables(left, right, "k", "k", coerce="loose").result.count() == 2


def test_hot_key_full_join_matches_spark(spark):
    left = spark.range(0, 3000).select(F.expr("if(id % 3 = 0, 7, id)").alias("k"), F.col("id").alias("a"))
    right = spark.range(0, 4000, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("b"))
    mine = join_tables(left, right, "k", "k", "full", {"k": "left.k", "a": "left.a", "b": "right.b"}).result
    theirs = left.alias("l").join(right.alias("r"), F.expr("l.k <=> r.k"), "full").selectExpr("l.k", "a", "b")
    assert mine.exceptAll(theirs).count() == 0
    assert theirs.exceptAll(mine).count() == 0


def test_branches(spark):
    a = spark.createDataFrame([(1, "x", 5)], "id int, v string, only_a int")
    b = spark.createDataFrame([(1, None), (2, "y")], "id int, v string")
    merged = {row["id"]: (row["v"], row["only_a"]) for row in merge_branches([a, b], "id").collect()}
    assert merged == {1: (None, 5), 2: ("y", None)}
    assert concat_branches([a, b]).groupBy("branch_no").count().count() == 2
    assert branch_names([("n1", "p"), ("n2", "p"), ("n3", "q"), (None, None)]) == ["n1.p", "n2.p", "q", "branch3"]
    assert with_branch_count(a, [a, b])[1] == 2
    assert with_branch_count(a, [a, b], "hidden") is a
