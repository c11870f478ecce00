"""Validate, map, join, query and aggregate: the end-to-end query."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftframe.operators.aggregating import aggregate
from weftframe.operators.joining import join_tables
from weftframe.operators.mapping import map_rows
from weftframe.operators.quality import check_rules
from weftframe.operators.querying import run_query
from weftframe.plans.registry import query

FLAGSHIP_SQL = """SELECT c_mktsegment AS key, round(sum(CAST(round_even(o_totalprice, 0) AS BIGINT)), 2)::DOUBLE AS result,
       count(*) AS count
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
WHERE o_totalprice >= 1000 AND o_orderstatus <> '' AND o_orderstatus = 'O'
GROUP BY c_mktsegment"""


@query("flagship", FLAGSHIP_SQL)
def flagship(spark, t):
    rules = [
        {"field": "o_orderstatus", "rule": "required"},
        {"field": "o_totalprice", "rule": "min", "value": 1000},
    ]
    valid = check_rules(t.orders, rules).valid
    mapping = {
        "id": "o_orderkey",
        "customer": "o_custkey",
        "status": "o_orderstatus",
        "total": {"path": "o_totalprice", "convert": "long"},
    }
    mapped = map_rows(valid, mapping).result
    select = {
        "id": "left.id",
        "status": "left.status",
        "total": "left.total",
        "segment": "right.c_mktsegment",
    }
    joined = join_tables(mapped, t.customer, "customer", "c_custkey", "left", select).result
    # the sum needs no order, so none is asked for
    open_orders = run_query(joined, where="item.status = 'O'").result
    summed = aggregate(open_orders, "sum", "total", group_by="segment")
    return summed.withColumn("result", F.round("result", 2))
