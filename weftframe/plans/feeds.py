"""Queries over the event feed, run as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftframe.plans.registry import query
from weftframe.streaming import feed

# Which lifecycle kind each event type of the test feed stands for.
KINDS = {"signup": "started", "view": "progress", "click": "progress", "purchase": "completed", "error": "failed"}

STATE_SQL = """CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'error' THEN 'Failed' ELSE 'Running' END"""


def _stream(spark, t):
    events = feed.read_table_feed(spark, f"{t.folder}/events.parquet")
    return feed.with_kind(events, KINDS)


def _latest(events):
    return feed.latest_state(events, ["user_id"], ["ts", "event_id"], "ts", "value", "props")


def _nodes(events):
    keyed = events.withColumn("node", F.get_json_object("props", "$.k"))
    return feed.node_state(keyed, ["user_id", "node"], ["ts", "event_id"], "value", "props")


NODES_SQL = f"""SELECT user_id, json_extract_string(props, '$.k') AS node, {STATE_SQL} AS state,
       CASE WHEN event_type IN ('purchase', 'error') THEN value END AS duration,
       CASE WHEN event_type = 'error' THEN props END AS error
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k')
                                         ORDER BY ts DESC, event_id DESC) = 1"""

# Last event of a user among those that decide a field, as a table per field.
FIELD_SQL = """(SELECT user_id, {value} AS v FROM events WHERE event_type IN ({types})
                QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""


@query(
    "stream_latest_state",
    f"""WITH u AS (SELECT user_id, count(*) AS events FROM events GROUP BY 1),
             s AS {FIELD_SQL.format(value=STATE_SQL, types="'signup','view','click','purchase','error'")},
             b AS {FIELD_SQL.format(value='ts', types="'signup'")},
             c AS {FIELD_SQL.format(value="CASE WHEN event_type <> 'signup' THEN ts END",
                                    types="'signup','purchase','error'")},
             d AS {FIELD_SQL.format(value='value', types="'purchase','error'")},
             e AS {FIELD_SQL.format(value="CASE WHEN event_type = 'error' THEN props END", types="'signup','error'")}
        SELECT u.user_id, s.v AS state, b.v AS started_at, c.v AS completed_at, d.v AS duration, e.v AS error, u.events
        FROM u LEFT JOIN s USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN c USING (user_id)
               LEFT JOIN d USING (user_id) LEFT JOIN e USING (user_id)""",
)
def stream_latest_state(spark, t):
    return feed.fold_stream(_stream(spark, t), _latest, ["user_id"])


@query(
    "stream_counters",
    """SELECT count(*) FILTER (event_type = 'signup') AS started, count(*) FILTER (event_type = 'purchase') AS completed,
              count(*) FILTER (event_type = 'error') AS failed, 0::BIGINT AS cancelled FROM events""",
)
def stream_counters(spark, t):
    return feed.fold_stream(_stream(spark, t), feed.lifecycle_counters, [])


@query(
    "stream_active",
    """SELECT greatest(count(*) FILTER (event_type = 'signup') - count(*) FILTER (event_type IN ('purchase', 'error')), 0)
              AS active FROM events""",
)
def stream_active(spark, t):
    return feed.active_gauge(feed.fold_stream(_stream(spark, t), feed.lifecycle_counters, []))


@query("stream_node_state", NODES_SQL)
def stream_node_state(spark, t):
    return feed.fold_stream(_stream(spark, t), _nodes, ["user_id", "node"])


@query(
    "stream_progress",
    f"""SELECT user_id, CAST(floor(count(*) FILTER (state = 'Completed') * 100.0 / count(*)) AS INTEGER) AS progress
        FROM ({NODES_SQL}) GROUP BY user_id""",
)
def stream_progress(spark, t):
    nodes = feed.fold_stream(_stream(spark, t), _nodes, ["user_id", "node"])
    return feed.progress_percent(nodes, ["user_id"])


@query(
    "stream_state_counts",
    f"""SELECT 0::BIGINT AS pending, count(*) FILTER (state = 'Running') AS running,
               count(*) FILTER (state = 'Completed') AS completed, count(*) FILTER (state = 'Failed') AS failed,
               0::BIGINT AS cancelled, 0::BIGINT AS retrying FROM ({NODES_SQL})""",
)
def stream_state_counts(spark, t):
    return feed.state_counts(feed.fold_stream(_stream(spark, t), _nodes, ["user_id", "node"]))


@query(
    "log_level",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'Error' WHEN event_type = 'signup' THEN 'Debug'
                             WHEN event_type = 'view' THEN 'Warning' ELSE 'Info' END AS level FROM events""",
)
def log_level(spark, t):
    words = F.create_map(
        *[F.lit(x) for pair in {"signup": "STARTED", "view": "was Cancelled", "error": "an Error"}.items() for x in pair]
    )
    line = F.concat_ws(" ", F.lit("node"), "user_id", F.coalesce(F.try_element_at(words, "event_type"), F.lit("done")))
    return t.events.select("event_id", feed.log_level(line).alias("level"))


@query(
    "feed_filter",
    f"""WITH s AS {FIELD_SQL.format(value=STATE_SQL, types="'signup','view','click','purchase','error'")},
             d AS {FIELD_SQL.format(value='value', types="'purchase','error'")}
        SELECT s.user_id, s.v AS state, d.v AS duration FROM s LEFT JOIN d USING (user_id) WHERE coalesce(d.v, 0) >= 20""",
)
def feed_filter(spark, t):
    states = _latest(feed.with_kind(t.events, KINDS))
    kept = feed.filter_feed(states, min_duration=20, sort="Duration", key="user_id")
    return kept.select("user_id", "state", "duration")
