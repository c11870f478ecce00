"""Queries over aggregation, joins and combining branches."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftframe.operators.aggregating import aggregate
from weftframe.operators.combining import (
    concat_branches,
    first_branch,
    last_branch,
    merge_branches,
    name_branches,
    with_branch_count,
)
from weftframe.operators.joining import join_tables
from weftframe.operators.routing import run_sql
from weftframe.plans.registry import query

# A size where it is a number, the type's name where it is not.
MIXED = "case when p_size > 25 then cast(p_size as string) else p_type end"


def _rounded(df, digits=2):
    return df.withColumn("result", F.round("result", digits))


@query("agg_count", "SELECT count(*) AS result FROM lineitem")
def agg_count(spark, t):
    return aggregate(t.lineitem, "count")


@query("agg_sum", "SELECT round(sum(l_extendedprice), 2) AS result FROM lineitem")
def agg_sum(spark, t):
    return _rounded(aggregate(t.lineitem, "sum", "l_extendedprice"))


@query(
    "agg_avg",
    """SELECT p_brand AS key, round(avg(CASE WHEN p_size > 25 THEN p_size END), 6) AS result, count(*) AS count
       FROM part GROUP BY p_brand""",
)
def agg_avg(spark, t):
    return _rounded(aggregate(t.part, "avg", MIXED, group_by="p_brand"), 6)


@query(
    "agg_min",
    """SELECT p_brand AS key, CAST(min(CASE WHEN p_size > 25 THEN p_size END) AS DOUBLE) AS result, count(*) AS count
       FROM part GROUP BY p_brand""",
)
def agg_min(spark, t):
    return aggregate(t.part, "min", MIXED, group_by="p_brand")


@query(
    "agg_max",
    """SELECT l_returnflag AS key, max(l_extendedprice) AS result, count(*) AS count
       FROM lineitem GROUP BY l_returnflag""",
)
def agg_max(spark, t):
    return aggregate(t.lineitem, "max", "l_extendedprice", group_by="l_returnflag")


@query(
    "agg_first",
    """SELECT user_id AS key, arg_min(event_type, (ts, event_id)) AS result, count(*) AS count
       FROM events GROUP BY user_id""",
)
def agg_first(spark, t):
    return aggregate(t.events, "first", "event_type", group_by="user_id", order_by=["ts", "event_id"])


@query(
    "agg_last",
    """SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS result, count(*) AS count
       FROM events GROUP BY user_id""",
)
def agg_last(spark, t):
    return aggregate(t.events, "last", "event_type", group_by="user_id", order_by=["ts", "event_id"])


@query(
    "agg_distinct",
    """SELECT nullif(p_type, 'PROMO') AS result, count(*) AS count, min(p_partkey) AS first_seen
       FROM part GROUP BY nullif(p_type, 'PROMO')""",
)
def agg_distinct(spark, t):
    found = aggregate(t.part, "distinct", "nullif(p_type, 'PROMO')", order_by=["p_partkey"])
    return found.select("result", "count", F.col("first_seen.o0").alias("first_seen"))


@query(
    "agg_median",
    """SELECT l_returnflag AS key, round(median(l_extendedprice), 4) AS result, count(*) AS count
       FROM lineitem GROUP BY l_returnflag""",
)
def agg_median(spark, t):
    return _rounded(aggregate(t.lineitem, "median", "l_extendedprice", group_by="l_returnflag"), 4)


@query("agg_median_all", "SELECT round(median(o_totalprice), 4) AS result FROM orders")
def agg_median_all(spark, t):
    return _rounded(aggregate(t.orders, "median", "o_totalprice"), 4)


@query(
    "agg_mode",
    """WITH c AS (SELECT user_id, nullif(event_type, 'view') AS v, count(*) AS n, min(event_id) AS f
                  FROM events GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM c)
       SELECT user_id AS key, max(CASE WHEN rn = 1 THEN v END) AS result, CAST(sum(n) AS BIGINT) AS count
       FROM r GROUP BY user_id""",
)
def agg_mode(spark, t):
    return aggregate(t.events, "mode", "nullif(event_type, 'view')", group_by="user_id", order_by=["event_id"])


@query(
    "group_by_path",
    """SELECT nullif(o_orderstatus, 'P') AS key, round(sum(o_totalprice), 2) AS result, count(*) AS count
       FROM orders GROUP BY nullif(o_orderstatus, 'P')""",
)
def group_by_path(spark, t):
    nested = t.orders.select("o_totalprice", F.struct(F.expr("nullif(o_orderstatus, 'P')").alias("code")).alias("status"))
    return _rounded(aggregate(nested, "sum", "o_totalprice", group_by="status.code"))


@query(
    "group_by_expr",
    """SELECT year(o_orderdate) AS key, round(avg(o_totalprice), 4) AS result, count(*) AS count
       FROM orders GROUP BY year(o_orderdate)""",
)
def group_by_expr(spark, t):
    grouped = aggregate(t.orders, "avg", "o_totalprice", group_by="year(item.o_orderdate)")
    return _rounded(grouped, 4).withColumn("key", F.col("key").cast("long"))


@query(
    "agg_empty",
    """SELECT coalesce(sum(l_quantity), 0.0) AS total, avg(l_quantity) AS mean, count(*) AS n
       FROM lineitem WHERE l_quantity < 0""",
)
def agg_empty(spark, t):
    nothing = t.lineitem.where("l_quantity < 0")
    total = aggregate(nothing, "sum", "l_quantity").select(F.col("result").alias("total"))
    mean = aggregate(nothing, "avg", "l_quantity").scalar()
    count = aggregate(nothing, "count").scalar()
    return total.withColumn("mean", mean).withColumn("n", count)


@query(
    "sql_agg",
    """SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey""",
)
def sql_agg(spark, t):
    return run_sql(
        spark,
        "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey",
        tables={"orders": t.orders},
    )


# --- joins -------------------------------------------------------------------


@query(
    "join_inner",
    """SELECT o_orderkey AS id, c_name AS name, c_mktsegment AS segment
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def join_inner(spark, t):
    select = {"id": "left.o_orderkey", "name": "right.c_name", "segment": "right.c_mktsegment"}
    return join_tables(t.orders, t.customer, "o_custkey", "c_custkey", "inner", select).result


@query(
    "join_left",
    """SELECT d.doc_id AS id, d.lang AS lang, l.quality AS quality
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def join_left(spark, t):
    select = {"id": "left.doc_id", "lang": "left.lang", "quality": "right.quality"}
    return join_tables(t.documents, t.labels, "doc_id", "doc_id", "left", select).result


@query(
    "join_full",
    """SELECT s_suppkey AS supplier, s_name AS name, p_partkey AS part
       FROM supplier FULL JOIN part ON s_suppkey = p_size * 3""",
)
def join_full(spark, t):
    select = {"supplier": "left.s_suppkey", "name": "left.s_name", "part": "right.p_partkey"}
    return join_tables(t.supplier, t.part, "s_suppkey", "p_size * 3", "full", select, once=True).result


@query(
    "join_expr_key",
    """SELECT o_orderkey AS id, n_name AS nation FROM orders
       JOIN nation ON substring(o_orderpriority, 1, 1) = CAST(n_nationkey AS VARCHAR)""",
)
def join_expr_key(spark, t):
    return join_tables(
        t.orders,
        t.nation,
        "substring(item.o_orderpriority, 1, 1)",
        "cast(item.n_nationkey as string)",
        "inner",
        {"id": "left.o_orderkey", "nation": "right.n_name"},
    ).result


@query(
    "join_null_safe",
    """WITH f AS (SELECT nullif(l_returnflag, 'N') AS flag, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT l_orderkey AS id, l_linenumber AS line, f.flag AS flag, f.n AS n
       FROM lineitem JOIN f ON nullif(l_returnflag, 'N') IS NOT DISTINCT FROM f.flag""",
)
def join_null_safe(spark, t):
    flags = t.lineitem.groupBy(F.expr("nullif(l_returnflag, 'N')").alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    return join_tables(
        t.lineitem,
        flags,
        "nullif(l_returnflag, 'N')",
        "flag",
        "inner",
        {"id": "left.l_orderkey", "line": "left.l_linenumber", "flag": "right.flag", "n": "right.n"},
    ).result


@query(
    "join_loose_key",
    """SELECT p_partkey AS part, s_name AS supplier FROM part JOIN supplier ON p_size = s_suppkey""",
)
def join_loose_key(spark, t):
    texts = t.part.withColumn("size_text", F.concat(F.col("p_size").cast("string"), F.lit(".0")))
    return join_tables(
        texts,
        t.supplier,
        "size_text",
        "s_suppkey",
        "inner",
        {"part": "left.p_partkey", "supplier": "right.s_name"},
        coerce="loose",
    ).result


@query(
    "join_unmatched",
    """SELECT (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT p_size * 3 FROM part)) AS "unmatchedLeft",
              (SELECT count(*) FROM part WHERE p_size * 3 NOT IN (SELECT s_suppkey FROM supplier)) AS "unmatchedRight"
    """,
)
def join_unmatched(spark, t):
    return join_tables(t.supplier, t.part, "s_suppkey", "p_size * 3").unmatched()


@query(
    "join_select",
    """SELECT c_name || '/' || n_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def join_select(spark, t):
    return join_tables(
        t.customer, t.nation, "c_nationkey", "n_nationkey", "inner", "concat(left.c_name, '/', right.n_name)"
    ).result


@query(
    "join_nested",
    """SELECT d.doc_id AS id, l.doc_id IS NULL AS alone, l.toxic AS toxic
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def join_nested(spark, t):
    joined = join_tables(t.documents, t.labels, "doc_id", "doc_id", "left").result
    return joined.select(
        F.col("doc_id").alias("id"), F.col("right").isNull().alias("alone"), F.col("right.toxic").alias("toxic")
    )


SQL_JOIN = """SELECT n.n_name AS nation, r.r_name AS region, count(*) AS customers
              FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
              JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name, r.r_name"""


@query("sql_join", SQL_JOIN.replace("{", "").replace("}", ""))
def sql_join(spark, t):
    return run_sql(spark, SQL_JOIN, tables={"customer": t.customer, "nation": t.nation, "region": t.region})


# --- branches ----------------------------------------------------------------


def _people(t):
    customers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_mktsegment")
    suppliers = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_acctbal")
    return [customers, suppliers]


@query(
    "combine_concat",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment, CAST(NULL AS DOUBLE) AS s_acctbal, 0 AS branch_no
       FROM customer
       UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal, 1 FROM supplier""",
)
def combine_concat(spark, t):
    return concat_branches(_people(t))


@query(
    "combine_merge",
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.source AS source, l.quality AS quality,
              CASE WHEN l.doc_id IS NULL THEN d.lang WHEN l.toxic = 0 THEN 'clean' END AS lang
       FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""",
)
def combine_merge(spark, t):
    base = t.documents.select("doc_id", "lang", "source")
    newer = t.labels.select("doc_id", "quality", F.when(F.col("toxic") == 0, "clean").alias("lang"))
    return merge_branches([base, newer], "doc_id")


@query(
    "combine_named",
    """SELECT 'people.rows' AS branch, c_custkey AS id FROM customer
       UNION ALL SELECT 'firms.rows', s_suppkey FROM supplier
       UNION ALL SELECT 'branch2', o_orderkey FROM orders""",
)
def combine_named(spark, t):
    customers, suppliers = _people(t)
    orders = t.orders.select(F.col("o_orderkey").alias("id"))
    return name_branches(
        [customers.select("id"), suppliers.select("id"), orders],
        [("people", "rows"), ("firms", "rows"), (None, None)],
    ).select("branch", "id")


@query(
    "combine_first_last",
    """SELECT 'first' AS pick, c_custkey AS id FROM customer UNION ALL SELECT 'last', o_orderkey FROM orders""",
)
def combine_first_last(spark, t):
    branches = [*[b.select("id") for b in _people(t)], t.orders.select(F.col("o_orderkey").alias("id"))]
    first = first_branch(branches).select(F.lit("first").alias("pick"), "id")
    return first.unionByName(last_branch(branches).select(F.lit("last").alias("pick"), "id"))


@query(
    "combine_count",
    """SELECT c_custkey AS id, 0 AS branch_no, 2 AS count FROM customer
       UNION ALL SELECT s_suppkey, 1, 2 FROM supplier""",
)
def combine_count(spark, t):
    branches = [b.select("id") for b in _people(t)]
    return with_branch_count(concat_branches(branches), branches, "embedded")


