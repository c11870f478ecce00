"""Queries over keyed and versioned tables; events serve as the history."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftframe.operators import history as h
from weftframe.operators.indexing import with_group_index
from weftframe.plans.registry import query


@query(
    "latest_per_key",
    """SELECT user_id, event_id, event_type, value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest_per_key(spark, t):
    rows = t.events.select("user_id", "event_id", "event_type", "value", "ts")
    return h.latest_per_key(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    "next_version",
    """WITH e AS (SELECT CASE WHEN user_id % 7 > 0 THEN user_id END AS user_id, event_id, ts, event_type FROM events),
            old AS (SELECT user_id, count(*) AS top FROM e WHERE event_type IN ('view', 'click') GROUP BY 1)
       SELECT e.user_id, e.event_id,
              coalesce(old.top, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS version
       FROM e LEFT JOIN old ON e.user_id IS NOT DISTINCT FROM old.user_id WHERE e.event_type NOT IN ('view', 'click')""",
)
def next_version(spark, t):
    """A seventh of the rows has no user: null is a key like others."""
    user = F.when(F.col("user_id") % 7 > 0, F.col("user_id"))
    rows = t.events.select(user.alias("user_id"), "event_id", "ts", "event_type")
    written = rows.where(F.col("event_type").isin("view", "click"))
    # versions so far run from 1 to the number of rows of the key
    so_far = written.groupBy("user_id").agg(F.count(F.lit(1)).alias("version"))
    incoming = rows.where(~F.col("event_type").isin("view", "click")).drop("event_type")
    return h.next_versions(so_far, incoming, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    "replay_prefix",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step
       FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 4""",
)
def replay_prefix(spark, t):
    rows = t.events.select("user_id", "event_id", "ts")
    steps = h.first_steps(rows, ["user_id"], ["ts", "event_id"], step=3).drop("ts")
    return steps.withColumn("step", F.col("step").cast("long"))


@query(
    "hist_list",
    """SELECT event_id, user_id, event_type, ts FROM events
       WHERE event_type IN ('error', 'purchase') AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-20'
       ORDER BY ts DESC, event_id LIMIT 50 OFFSET 50""",
)
def hist_list(spark, t):
    return h.list_rows(
        t.events.select("event_id", "user_id", "event_type", "ts"),
        states=["error", "purchase"],
        started_from=F.lit("2024-01-02").cast("timestamp_ntz"),
        started_to=F.lit("2024-01-20").cast("timestamp_ntz"),
        page=2,
        state="event_type",
        started="ts",
        tiebreak="event_id",
    ).items


@query(
    "hist_upsert",
    """WITH e AS (SELECT * REPLACE (CASE WHEN user_id % 7 > 0 THEN user_id END AS user_id) FROM events),
            target AS (SELECT user_id, event_type AS state, value, ts AS started_at FROM e WHERE event_type = 'view'
                       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
            inc AS (SELECT user_id, arg_max(event_type, event_id) AS state, arg_max(value, event_id) AS value,
                           arg_min(ts, event_id) AS started_at
                    FROM e WHERE event_type IN ('error', 'purchase') GROUP BY user_id)
       SELECT coalesce(t.user_id, i.user_id) AS user_id, coalesce(i.state, t.state) AS state,
              coalesce(i.value, t.value) AS value, coalesce(t.started_at, i.started_at) AS started_at
       FROM target t FULL JOIN inc i ON t.user_id IS NOT DISTINCT FROM i.user_id""",
)
def hist_upsert(spark, t):
    """A seventh of the rows has no user: null is a key like others."""
    user = F.when(F.col("user_id") % 7 > 0, F.col("user_id"))
    rows = t.events.select(
        user.alias("user_id"), F.col("event_type").alias("state"), "value", F.col("ts").alias("started_at"), "event_id"
    )
    target = h.latest_per_key(rows.where("state = 'view'"), ["user_id"], ["event_id"]).drop("event_id")
    incoming = rows.where(F.col("state").isin("error", "purchase"))
    return h.upsert(target, incoming, ["user_id"], ["state", "value"], ["event_id"])


@query(
    "hist_children",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position
       FROM events""",
)
def hist_children(spark, t):
    rows = t.events.select("user_id", "event_id", "ts")
    return h.ordered_children(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    "hist_update",
    """SELECT o_orderkey, CASE WHEN r.n IS NULL THEN o_orderstatus ELSE 'R' END AS o_orderstatus,
              coalesce(r.total, o_totalprice) AS o_totalprice
       FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_extendedprice) AS total FROM lineitem
                              WHERE l_returnflag = 'R' GROUP BY 1) r ON o_orderkey = l_orderkey""",
)
def hist_update(spark, t):
    returned = (
        t.lineitem.where("l_returnflag = 'R'")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.max("l_extendedprice").alias("o_totalprice"))
        .withColumn("o_orderstatus", F.lit("R"))
    )
    target = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return h.update_by_key(target, returned, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


def _variables(t):
    """One variable per user and event type, versioned by event number."""
    return t.events.select(
        F.col("event_type").alias("scope"), F.col("user_id").alias("name"), "value", F.col("event_id").alias("version")
    )


@query(
    "var_latest",
    """WITH l AS (SELECT user_id, event_id, nullif(event_type, 'click') AS v FROM events
                  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
       SELECT c_custkey AS name, CASE WHEN l.user_id IS NULL THEN 'absent' ELSE l.v END AS value,
              l.event_id AS version, l.user_id IS NOT NULL AS found
       FROM customer LEFT JOIN l ON c_custkey = user_id""",
)
def var_latest(spark, t):
    rows = t.events.select(
        F.col("user_id").alias("name"), F.expr("nullif(event_type, 'click')").alias("value"), F.col("event_id").alias("version")
    )
    asked = t.customer.select(F.col("c_custkey").alias("name"))
    return h.version_of(rows, ["name"], "value", requested=asked, default="absent")


@query(
    "var_at_version",
    """SELECT user_id AS name, value, CAST(2 AS BIGINT) AS version FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 2""",
)
def var_at_version(spark, t):
    rows = t.events.select(F.col("user_id").alias("name"), "value", "event_id")
    versioned = with_group_index(rows, ["name"], ["event_id"], "_n").withColumn("version", F.col("_n") + 1)
    return h.version_of(versioned, ["name"], "value", wanted=2)


@query(
    "var_history",
    """SELECT user_id AS name, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, value
       FROM events""",
)
def var_history(spark, t):
    rows = t.events.select(F.col("user_id").alias("name"), "value", "event_id")
    versioned = with_group_index(rows, ["name"], ["event_id"], "_n").withColumn("version", F.col("_n") + 1)
    return versioned.select("name", "version", "value").orderBy("name", "version")


@query(
    "var_all_latest",
    """SELECT event_type AS scope, user_id AS name, value, event_id AS version FROM events
       QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) = 1""",
)
def var_all_latest(spark, t):
    return h.latest_per_key(_variables(t), ["scope", "name"], ["version"])


@query(
    "del_by_key",
    """SELECT o_orderkey, o_custkey FROM orders
       WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def del_by_key(spark, t):
    doomed = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return h.delete_by_key(t.orders.select("o_orderkey", "o_custkey"), doomed, ["o_custkey"])


@query(
    "soft_delete",
    """WITH c AS (SELECT *, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS hit FROM customer)
       SELECT c_custkey, c_acctbal > 0 AND NOT hit AS is_active,
              CASE WHEN hit AND c_acctbal > 0 THEN 1 ELSE 0 END AS updated_at FROM c""",
)
def soft_delete(spark, t):
    table = t.customer.select(
        "c_custkey", (F.col("c_acctbal") > 0).alias("is_active"), F.lit(0).alias("updated_at")
    )
    ids = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return h.set_active(table, ids, "c_custkey", False, F.lit(1))


@query(
    "purge_cascade",
    """WITH c AS (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY'),
            dead AS (SELECT o_orderkey FROM orders WHERE o_custkey IN
                     (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'))
       SELECT 'customer' AS level, c_custkey AS id FROM c
       UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_orderkey NOT IN (FROM dead)
       UNION ALL SELECT 'lineitem', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (FROM dead)""",
)
def purge_cascade(spark, t):
    doomed = t.customer.where("c_mktsegment = 'MACHINERY'")
    kept = h.purge_cascade(
        doomed,
        [
            (t.customer, "c_custkey", "c_custkey"),
            (t.orders, "o_orderkey", "o_custkey"),
            (t.lineitem, "l_linenumber", "l_orderkey"),
        ],
        "c_custkey",
    )
    names = [("customer", "c_custkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey")]
    parts = [df.select(F.lit(n).alias("level"), F.col(k).alias("id")) for df, (n, k) in zip(kept, names)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "text_search",
    """SELECT doc_id FROM documents
       WHERE (contains(lower(text), 'and the') OR contains(lower(source), 'and the')) AND n_chars > 100""",
)
def text_search(spark, t):
    docs = t.documents.withColumn("active", F.col("n_chars") > 100)
    return h.text_search(docs, "And THE", ["text", "source"], active="active").select("doc_id")


@query(
    "tags_all",
    """SELECT p_partkey FROM part WHERE list_has_all(string_split(p_name, ' '), ['red', 'widget'])""",
)
def tags_all(spark, t):
    tagged = t.part.withColumn("tags", F.split("p_name", " "))
    return h.has_all_tags(tagged, "tags", ["red", "widget"]).select("p_partkey")


@query(
    "newest_version",
    """SELECT p_brand AS name, p_partkey, '1.' || p_size || '.' || p_partkey AS version FROM part
       QUALIFY row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_size DESC, p_partkey DESC) = 1""",
)
def newest_version(spark, t):
    rows = t.part.select(
        F.col("p_brand").alias("name"), "p_partkey", F.concat_ws(".", F.lit("1"), "p_size", "p_partkey").alias("version")
    )
    return h.newest_version(rows, "name", "version")


@query(
    "param_sets_update",
    """WITH s AS (SELECT l_orderkey, l_linestatus, l_extendedprice FROM lineitem
                  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC,
                                             l_suppkey DESC, l_extendedprice DESC) = 1)
       SELECT o_orderkey, coalesce(l_linestatus, o_orderstatus) AS o_orderstatus,
              coalesce(l_extendedprice, o_totalprice) AS o_totalprice
       FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""",
)
def param_sets_update(spark, t):
    sets = t.lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_linestatus").alias("o_orderstatus"),
        F.col("l_extendedprice").alias("o_totalprice"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )
    target = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return h.apply_parameter_sets(
        target,
        sets,
        ["o_orderkey"],
        ["o_orderstatus", "o_totalprice"],
        ["l_linenumber", "l_partkey", "l_suppkey", "o_totalprice"],
    )


@query(
    "param_sets_affected",
    "SELECT count(*) AS affected FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
)
def param_sets_affected(spark, t):
    sets = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return h.affected_rows(t.orders, sets, ["o_orderkey"])
