"""Full joins with heavy keys: the same rows as Spark's own, in one pass over both sides."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftframe.operators import joining
from weftframe.operators.joining import join_tables

LEFT = "if(id % 3 = 0, {hot}, id % 40)"
RIGHT = "if(id % 2 = 0, {other}, id % 50)"


def sides(spark, hot, other, kind):
    left = spark.range(0, 240, 1, 5).selectExpr(f"cast({LEFT.format(hot=hot)} as {kind}) as k", "id as a")
    right = spark.range(0, 40, 1, 4).selectExpr(f"cast({RIGHT.format(other=other)} as {kind}) as k", "id as b")
    return left, right


@pytest.mark.parametrize("heavy_rows", [5, 1_000_000])
@pytest.mark.parametrize("nulls_meet", [True, False])
@pytest.mark.parametrize("hot, other, kind", [("7", "7", "bigint"), ("null", "null", "string"), ("null", "45", "int"), ("99", "98", "double"), ("3", "null", "decimal(10,2)"), ("1", "1", "timestamp_ntz")])
def test_same_rows_as_a_plain_full_join(spark, monkeypatch, heavy_rows, nulls_meet, hot, other, kind):
    monkeypatch.setattr(joining, "HEAVY_ROWS", heavy_rows)
    if kind == "timestamp_ntz":
        left, right = (d.withColumn("k", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(k as int))")) for d in sides(spark, hot, other, "bigint"))
    else:
        left, right = sides(spark, hot, other, kind)
    got = join_tables(left, right, "k", "k", "full", {"lk": "left.k", "a": "left.a", "rk": "right.k", "b": "right.b"}, null_matches_null=nulls_meet, once=True).result
    same = left["k"].eqNullSafe(right["k"]) if nulls_meet else left["k"] == right["k"]
    want = left.join(right, same, "full").select(left["k"].alias("lk"), "a", right["k"].alias("rk"), "b")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    nested = join_tables(left, right, "k", "k", "full", null_matches_null=nulls_meet, once=True).result
    assert nested.columns == ["k", "a", "right"] and nested.count() == want.count()
    assert nested.where("right is null").count() == want.where("b is null").count()


def test_keys_of_two_types_meet(spark, monkeypatch):
    monkeypatch.setattr(joining, "HEAVY_ROWS", 5)
    left, right = sides(spark, "7", "7", "int")
    right = right.withColumn("k", F.col("k").cast("double"))
    got = join_tables(left, right, "k", "k", "full", {"a": "left.a", "b": "right.b"}, once=True).result
    want = left.join(right, left["k"].eqNullSafe(right["k"]), "full").select("a", "b")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_each_side_is_scanned_once(spark, monkeypatch, small):
    monkeypatch.setattr(joining, "HEAVY_ROWS", 10)
    suppliers, customers = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("supplier", "customer"))
    plan = join_tables(suppliers, customers, "s_nationkey", "c_nationkey", "full", once=True).result._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2


def test_a_heavy_key_is_spread(spark, monkeypatch):
    monkeypatch.setattr(joining, "HEAVY_ROWS", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = spark.range(0, 3_000, 1, 6).selectExpr("if(id % 3 > 0, 5, id) as k", "id as a")
        right = spark.range(0, 10).selectExpr("id as k", "id as b")
        spread, *_ = joining._spread(joining._keyed(left, "k", "_lk", None), joining._keyed(right, "k", "_rk", None), True)
        parts = spread.where("_lk = 5").groupBy("_lp").count().collect()
        assert len(parts) == 20 and max(r["count"] for r in parts) < 250
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
