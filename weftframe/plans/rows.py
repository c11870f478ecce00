"""Queries over projection, filtering, routing, sorting and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftframe.operators.indexing import with_row_index
from weftframe.operators.mapping import map_rows, record_without_nulls
from weftframe.operators.querying import (
    filter_rows,
    page_rows,
    project_expression,
    project_mapping,
    run_query,
    sort_rows,
)
from weftframe.operators.routing import route_if, route_switch, run_sql
from weftframe.plans.registry import query

ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query(
    "filter_where",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount FROM lineitem
       WHERE l_quantity > 30 AND l_discount >= 0.05 AND l_shipdate < TIMESTAMP '1998-09-02'""",
)
def filter_where(spark, t):
    kept = filter_rows(
        t.lineitem,
        "item.l_quantity > 30 and item.l_discount >= 0.05 and item.l_shipdate < timestamp_ntz '1998-09-02'",
    )
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")


@query("project_expr", "SELECT round(l_extendedprice * (1 - l_discount), 4) AS value FROM lineitem")
def project_expr(spark, t):
    return project_expression(t.lineitem, "round(item.l_extendedprice * (1 - item.l_discount), 4)")


@query(
    "project_map",
    """SELECT l_orderkey AS order_id, l_quantity * 2 AS doubled, 7 AS source FROM lineitem""",
)
def project_map(spark, t):
    return project_mapping(t.lineitem, {"order_id": "l_orderkey", "doubled": "item.l_quantity * 2", "source": 7})


@query(
    "map_rename",
    """SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS head, label AS grp,
              CAST(NULL AS DOUBLE) AS beyond FROM embeddings""",
)
def map_rename(spark, t):
    nested = t.embeddings.withColumn("meta", F.struct("label"))
    mapping = {
        "id": "vec_id",
        "head": {"path": "embedding.0", "convert": "double"},
        "grp": "meta.label",
        "beyond": {"path": "embedding.99999", "convert": "double"},
    }
    return map_rows(nested, mapping).result


@query(
    "map_default",
    """SELECT c_custkey AS id, coalesce(nullif(c_mktsegment, 'BUILDING'), 'NONE') AS segment,
              0 AS absent FROM customer""",
)
def map_default(spark, t):
    source = t.customer.withColumn("segment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    mapping = {
        "id": "c_custkey",
        "segment": {"path": "segment", "default": "NONE"},
        "absent": {"path": "no.such.field", "default": 0},
    }
    return map_rows(source, mapping).result


@query(
    "map_convert",
    """SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
              CAST(round_even(value, 0) AS INTEGER) AS whole, CAST(user_id AS VARCHAR) AS user_text FROM events""",
)
def map_convert(spark, t):
    source = t.events.withColumn("k", F.get_json_object("props", "$.k"))
    mapping = {
        "id": "event_id",
        "k": {"path": "k", "convert": "int"},
        "whole": {"path": "value", "convert": "int"},
        "user_text": {"path": "user_id", "convert": "string"},
    }
    return map_rows(source, mapping).result


@query(
    "map_compute",
    """SELECT event_id AS id, CASE WHEN value > 50 THEN 'big' ELSE 'small' END AS size FROM events""",
)
def map_compute(spark, t):
    mapping = {"id": "event_id", "size": {"expression": "case when item.value > 50 then 'big' else 'small' end"}}
    return map_rows(t.events, mapping).result


@query(
    "map_flatten",
    """SELECT c_custkey AS id, c_name AS who_name, c_nationkey AS who_place_nation FROM customer""",
)
def map_flatten(spark, t):
    nested = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation")).alias("place")).alias(
            "who"
        ),
    )
    flat = map_rows(nested, {"id": "id", "who": "who"}, flatten=True).result
    # dotted names are awkward to quote everywhere
    return flat.toDF(*[c.replace(".", "_") for c in flat.columns])


@query(
    "map_ignore_nulls",
    """SELECT '{"id":' || c_custkey || CASE WHEN c_mktsegment = 'BUILDING' THEN ''
              ELSE ',"segment":"' || c_mktsegment || '"' END || '}' AS record FROM customer""",
)
def map_ignore_nulls(spark, t):
    mapping = {"id": "c_custkey", "segment": {"expression": "nullif(item.c_mktsegment, 'BUILDING')"}}
    return record_without_nulls(map_rows(t.customer, mapping).result)


@query(
    "row_index",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS index FROM orders""",
)
def row_index(spark, t):
    return with_row_index(t.orders.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select(
        "o_orderkey", "index"
    )


@query(
    "route_if",
    """SELECT l_orderkey, l_linenumber, l_partkey,
              CASE WHEN l_returnflag = 'R' THEN 'true' ELSE 'false' END AS port FROM lineitem""",
)
def route_if_query(spark, t):
    source = t.lineitem.withColumn("returned", F.when(F.col("l_returnflag") == "R", " Yes ").otherwise("off"))
    yes, no = route_if(source, "returned")
    columns = ["l_orderkey", "l_linenumber", "l_partkey"]
    return yes.select(*columns, F.lit("true").alias("port")).unionByName(
        no.select(*columns, F.lit("false").alias("port"))
    )


@query(
    "route_switch",
    """SELECT p_partkey, CASE upper(p_type) WHEN 'ECONOMY' THEN 'cheap' WHEN 'PROMO' THEN 'sale'
              WHEN 'STANDARD' THEN 'plain' ELSE 'other' END AS port FROM part""",
)
def route_switch_query(spark, t):
    cases = [
        {"match": "economy", "port": "cheap"},
        {"match": "Promo", "port": "sale"},
        {"match": "STANDARD", "port": "plain"},
        {"match": "economy", "port": "never"},
    ]
    return route_switch(t.part, "p_type", cases, default="other").select("p_partkey", "port")


@query(
    "param_binding",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
       WHERE l_quantity >= 25 AND l_returnflag = 'A' AND l_shipdate >= TIMESTAMP '1996-01-01'""",
)
def param_binding(spark, t):
    text = """SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem}
              WHERE l_quantity >= {{Variable.limits.quantity}} AND l_returnflag = {{Variable.flag}}
                AND l_shipdate >= {{Variable.limits.since}}"""
    return run_sql(
        spark,
        text.replace("{lineitem}", "{lines}"),
        tables={"lines": t.lineitem},
        variables={"Limits": {"quantity": "25", "since": "1996-01-01"}, "flag": "A"},
        types={"limits.quantity": "int", "limits.since": "datetime"},
    )


@query("sort_asc", f"SELECT {ORDER_COLUMNS} FROM orders ORDER BY o_totalprice, o_orderkey")
def sort_asc(spark, t):
    return sort_rows(t.orders, "o_totalprice", tiebreak=["o_orderkey"])


@query("sort_desc", "SELECT event_id, props FROM events")
def sort_desc(spark, t):
    return sort_rows(t.events.select("event_id", "props"), "get_json_object(item.props, '$.k')", descending=True)


@query(
    "skip_take",
    f"SELECT {ORDER_COLUMNS} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 120",
)
def skip_take(spark, t):
    return run_query(
        t.orders, order_by="o_totalprice", descending=True, skip=120, take=50, tiebreak=["o_orderkey"]
    ).result


@query(
    "skip_only",
    f"SELECT {ORDER_COLUMNS} FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 120",
)
def skip_only(spark, t):
    """No upper bound: goes by the distributed row index."""
    return run_query(t.orders, order_by="o_totalprice", descending=True, skip=120, tiebreak=["o_orderkey"]).result


@query(
    "top_k",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
       ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100""",
)
def top_k(spark, t):
    return run_query(
        t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"),
        order_by="l_extendedprice",
        descending=True,
        take=100,
        tiebreak=["l_orderkey", "l_linenumber"],
    ).result


@query("total_count", """SELECT count(*) AS "totalCount" FROM lineitem WHERE l_quantity > 30""")
def total_count(spark, t):
    return run_query(t.lineitem, where="item.l_quantity > 30", order_by="l_orderkey").total_count()


@query(
    "page",
    f"SELECT {ORDER_COLUMNS} FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40 OFFSET 80",
)
def page(spark, t):
    return page_rows(t.orders, [F.col("o_orderdate").desc(), "o_orderkey"], page=3, page_size=40).items


@query(
    "page_info",
    """SELECT count(*) AS "totalCount", 3 AS page, 40 AS "pageSize",
              CAST(ceil(count(*) / 40.0) AS BIGINT) AS "totalPages",
              3 < ceil(count(*) / 40.0) AS "hasNext", true AS "hasPrevious" FROM orders""",
)
def page_info(spark, t):
    return page_rows(t.orders, [F.col("o_orderdate").desc(), "o_orderkey"], page=3, page_size=40).info


@query(
    "query_fixed_order",
    """SELECT o_orderkey AS id, round(o_totalprice / 2, 4) AS half FROM orders
       WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10""",
)
def query_fixed_order(spark, t):
    return run_query(
        t.orders,
        where="item.o_orderstatus = 'O'",
        order_by="o_totalprice",
        descending=True,
        skip=10,
        take=25,
        select={"id": "o_orderkey", "half": "round(item.o_totalprice / 2, 4)"},
        tiebreak=["o_orderkey"],
    ).result
