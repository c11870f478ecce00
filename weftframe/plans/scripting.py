"""Queries over user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from weftframe.functions import scripts
from weftframe.plans.registry import query


@query(
    "udf_table",
    """SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem
       WHERE l_quantity >= 20 GROUP BY l_returnflag""",
)
def udf_table(spark, t):
    def busy_flags(rows, least):
        big = rows.where(F.col("l_quantity") >= least)
        return big.groupBy("l_returnflag").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")
        )

    return scripts.table_script(t.lineitem, busy_flags, least=20)


@query(
    "udf_rows",
    """SELECT l_orderkey AS id, l_quantity * 2 AS twice FROM lineitem WHERE l_discount > 0.05""",
)
def udf_rows(spark, t):
    def double(batch: pd.DataFrame) -> pd.DataFrame:
        kept = batch[batch["l_discount"] > 0.05]
        return pd.DataFrame({"id": kept["l_orderkey"], "twice": kept["l_quantity"] * 2})

    source = t.lineitem.select("l_orderkey", "l_quantity", "l_discount")
    return scripts.batch_script(source, double, "id long, twice double")


@query(
    "udf_group",
    """SELECT l_returnflag, CAST(sum(l_quantity) AS DOUBLE) AS total, count(*) AS n FROM lineitem
       GROUP BY l_returnflag""",
)
def udf_group(spark, t):
    def partial(batch: pd.DataFrame) -> pd.DataFrame:
        grouped = batch.groupby("l_returnflag", dropna=False)["l_quantity"]
        return grouped.agg(total="sum", n="size").reset_index()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.groupby("l_returnflag", dropna=False).sum().reset_index()

    source = t.lineitem.select("l_returnflag", "l_quantity")
    return scripts.group_script(source, ["l_returnflag"], partial, merge, "l_returnflag string, total double, n long")


@query(
    "udf_scalar",
    """SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS size, contains(p_name, 'red') AS red, upper(p_brand) AS loud,
              length(p_name) * p_size AS weight FROM part""",
)
def udf_scalar(spark, t):
    @F.pandas_udf("long")
    def weigh(text: pd.Series, size: pd.Series) -> pd.Series:
        return text.str.len() * size

    spark.udf.register("weigh", weigh)
    return t.part.selectExpr(
        "p_partkey",
        "len(p_name) AS size",
        "contains(p_name, 'red') AS red",
        "upper(p_brand) AS loud",
        "weigh(p_name, p_size) AS weight",
    )


@query(
    "foreach_capture",
    """SELECT p_partkey, CASE WHEN p_size > 10 THEN CAST(100 // (p_size) AS BIGINT) END AS result,
              CASE WHEN p_size <= 10 THEN 'ValueError: too small' END AS _error FROM part""",
)
def foreach_capture(spark, t):
    def share(item):
        if item["p_size"] <= 10:
            raise ValueError("too small")
        return 100 // item["p_size"]

    return scripts.for_each(t.part.select("p_partkey", "p_size"), share, "long").drop("p_size")


@query("fanout_items", "SELECT p_partkey, p_size + 1 AS result FROM part")
def fanout_items(spark, t):
    def work(item):
        return item["p_size"] + 1

    done = scripts.for_each(t.part.select("p_partkey", "p_size"), work, "int", on_error="fail")
    return done.select("p_partkey", "result")


@query(
    "typed_query",
    """SELECT c_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 300000""",
)
def typed_query(spark, t):
    def large_orders(tables, least):
        orders, customers = tables["orders"], tables["customer"]
        joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
        return joined.where(F.col("o_totalprice") >= least).select("c_name", "o_orderkey")

    tables = {"orders": t.orders, "customer": t.customer}
    return scripts.typed_query(large_orders, tables, {"least": 300000.0}, {"least": "double"})


@query(
    "preview",
    """SELECT c_mktsegment, count(*) AS n FROM (SELECT * FROM customer ORDER BY ALL NULLS FIRST LIMIT 20) GROUP BY 1""",
)
def preview(spark, t):
    def per_segment(tables):
        return tables["customer"].groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))

    return scripts.preview(per_segment, {"customer": t.customer}, rows=20, generated=False)
