"""Versioned tables, user functions and the event feed."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftframe.expressions import TransformError
from weftframe.functions import scripts
from weftframe.operators import history as h
from weftframe.session import scratch_path
from weftframe.streaming import feed


@pytest.fixture(scope="module")
def variables(spark):
    return spark.createDataFrame(
        [("a", "1", 1), ("a", None, 2), ("b", "x", 1), ("b", "y", 10), ("b", "z", 9)],
        "name string, value string, version int",
    )


def test_versions(spark, variables):
    latest = {r["name"]: r["value"] for r in h.latest_per_key(variables, ["name"], ["version"]).collect()}
    assert latest == {"a": None, "b": "y"}
    asked = spark.createDataFrame([("a",), ("c",)], "name string")
    got = {r["name"]: (r["value"], r["found"]) for r in h.version_of(variables, ["name"], "value", requested=asked, default="d").collect()}
    assert got == {"a": (None, True), "c": ("d", False)}
    assert h.version_of(variables, ["name"], "value", wanted=1).count() == 2
    with pytest.raises(PySparkException):
        h.version_of(variables, ["name"], "value", requested=asked, required=True).collect()


def test_next_versions(spark, variables):
    incoming = spark.createDataFrame([("b", 1), ("b", 2), ("n", 3)], "name string, at int")
    rows = h.next_versions(variables, incoming, ["name"], ["at"]).collect()
    assert {(r["name"], r["at"]): r["version"] for r in rows} == {("b", 1): 11, ("b", 2): 12, ("n", 3): 1}


def test_upsert_keeps_insert_only_columns(spark):
    schema = "run int, node string, state string, started int"
    target = spark.createDataFrame([(1, "a", "Running", 5)], schema)
    incoming = spark.createDataFrame(
        [(1, "a", "Done", 9, 1), (2, "b", "Running", 7, 2), (2, "b", "Done", 8, 3)], schema + ", seq int"
    )
    rows = {(r["run"], r["node"]): (r["state"], r["started"]) for r in h.upsert(target, incoming, ["run", "node"], ["state"], ["seq"]).collect()}
    assert rows == {(1, "a"): ("Done", 5), (2, "b"): ("Done", 7)}


def test_first_steps_small_and_large(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("run"), F.col("id").alias("at"))
    assert h.first_steps(df, ["run"], ["at"], 2).count() == 6
    assert h.first_steps(df, ["run"], ["at"], 1500).count() == 3002
    assert h.first_steps(df, ["run"], ["at"], 9999).count() == 4000


def test_purge_and_soft_delete(spark):
    a = spark.createDataFrame([(1,), (2,)], "a int")
    b = spark.createDataFrame([(10, 1), (20, 2)], "b int, a int")
    c = spark.createDataFrame([(100, 10), (200, 20)], "c int, b int")
    kept = h.purge_cascade(a.where("a = 1"), [(a, "a", "a"), (b, "b", "a"), (c, "c", "b")], "a")
    assert [[r[0] for r in df.collect()] for df in kept] == [[2], [20], [200]]
    table = spark.createDataFrame([(1, True, 0), (2, False, 0)], "id int, is_active boolean, updated_at int")
    ids = spark.createDataFrame([(1,), (2,)], "id int")
    gone = {r["id"]: (r["is_active"], r["updated_at"]) for r in h.set_active(table, ids, "id", False, F.lit(9)).collect()}
    assert gone == {1: (False, 9), 2: (False, 0)}


def test_newest_version_is_numeric(spark):
    df = spark.createDataFrame([("Flow", "1.9"), ("flow", "1.10"), ("x", "2.0")], "name string, version string")
    assert {r["version"] for r in h.newest_version(df, "name", "version").collect()} == {"1.10", "2.0"}
    assert h.newest_version(df, "name", "version", pinned="1.9").first()["name"] == "Flow"


def test_group_script_sees_no_whole_group(spark):
    seen = scratch_path(spark, "unused")
    assert seen
    df = spark.range(0, 50_000, 1, 8).select(F.lit("hot").alias("k"), F.col("id").alias("v"))

    def partial(batch):
        return batch.groupby("k")["v"].agg(total="sum", n="size").reset_index()

    def merge(rows):
        assert len(rows) <= 16
        return rows.groupby("k").sum().reset_index()

    row = scripts.group_script(df, ["k"], partial, merge, "k string, total long, n long").first()
    assert (row["total"], row["n"]) == (sum(range(50_000)), 50_000)


def test_for_each(spark):
    df = spark.createDataFrame([(2,), (0,)], "n int")
    rows = {r["n"]: (r["result"], r["_error"]) for r in scripts.for_each(df, lambda i: 10 // i["n"], "int").collect()}
    assert rows[2] == (5, None)
    assert rows[0][0] is None and rows[0][1].startswith("ZeroDivisionError")
    with pytest.raises(PySparkException):
        scripts.for_each(df, lambda i: 10 // i["n"], "int", on_error="fail").collect()
    with pytest.raises(TransformError):
        scripts.for_each(df, lambda i: 1, "int", max_items=1)


def test_for_each_passes_columns_through_unchanged(spark):
    import datetime as dt
    from decimal import Decimal

    at = dt.datetime(2024, 1, 2, 3, 4, 5, 678901)
    rows = [(2**53 + 1, Decimal("12345678901234567890.123456789"), at), (None, None, None), (5, Decimal("1"), at)]
    df = spark.createDataFrame(rows, "n long, d decimal(38,9), t timestamp")
    got = scripts.for_each(df, lambda i: i["n"], "long", parallelism=3, position="at").orderBy("at").collect()
    assert [(r["n"], r["d"], r["t"]) for r in got] == rows
    assert [r["result"] for r in got] == [2**53 + 1, None, 5]
    bad = scripts.for_each(df, lambda i: "text", "long").collect()
    assert all(r["result"] is None and r["_error"] for r in bad)


def test_typed_query_and_preview(spark):
    tables = {"t": spark.range(10)}

    def query(tables, least=0):
        return tables["t"].where(F.col("id") >= least)

    assert scripts.typed_query(query, tables, {"least": 5}, {"least": "long"}).count() == 5
    for inputs, types in (({"least": "x"}, {"least": "long"}), ({}, {"least": "long"}), ({"z": 1}, {"least": "long?"})):
        with pytest.raises(TransformError):
            scripts.typed_query(query, tables, inputs, types)
    with pytest.raises(TransformError, match="unknown table"):
        scripts.typed_query(lambda t: t["nope"], tables)
    with pytest.raises(PySparkException):
        scripts.typed_query(lambda t: t["t"].select("nope"), tables)
    assert scripts.preview(query, tables, rows=3).count() == 3
    assert scripts.preview(query, tables, rows=3, generated=False).count() == 3


KINDS = {"signup": "started", "view": "progress", "click": "progress", "purchase": "completed", "error": "failed"}


@pytest.mark.parametrize("batches", [1, 5])
def test_stream_equals_batch(spark, small, batches):
    events = spark.read.parquet(f"{small}/events.parquet")
    folder = scratch_path(spark, "events")
    # out of order on purpose: a batch holds events from anywhere in time
    events.repartition(batches, "event_id").write.parquet(folder)

    def fold(rows):
        return feed.latest_state(feed.with_kind(rows, KINDS), ["user_id"], ["ts", "event_id"], "ts", "value", "props")

    stream = feed.read_feed(spark, folder, events.schema, files_per_batch=1)
    streamed = feed.fold_stream(stream, fold, ["user_id"])
    expected = fold(events)
    assert streamed.exceptAll(expected.select(streamed.columns)).count() == 0
    assert expected.exceptAll(streamed.select(expected.columns)).count() == 0


def test_stream_goes_on_where_it_stopped(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    folder, out, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "cp"))
    half = events.count() // 2

    def run():
        stream = feed.with_kind(feed.read_feed(spark, folder, events.schema), KINDS)
        return feed.fold_stream(stream, feed.lifecycle_counters, [], out, checkpoint).first()

    events.where(F.col("event_id") < half).write.parquet(folder)
    first = run()
    events.where(F.col("event_id") >= half).write.mode("append").parquet(folder)
    second = run()
    whole = feed.lifecycle_counters(feed.with_kind(events, KINDS)).first()
    assert second.asDict() == whole.asDict()
    assert first["started"] < second["started"]


def test_feeds_of_a_folder_and_of_a_file_are_alike(spark, small, tmp_path):
    from weftframe.plans import QUERIES

    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("stream_counters", "stream_active", "stream_state_counts"):
        assert QUERIES[name](spark, str(tmp_path)).collect() == QUERIES[name](spark, small).collect()
    with pytest.raises(PySparkException):
        feed.read_table_feed(spark, f"{tmp_path}/nothing.parquet")
    few = spark.createDataFrame([("started",), ("completed",), ("failed",)], "kind string")
    assert feed.active_gauge(feed.lifecycle_counters(few)).first()["active"] == 0


def test_stream_without_events_is_empty(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    folder = scratch_path(spark, "none")
    events.where("false").coalesce(1).write.parquet(folder)
    stream = feed.read_feed(spark, folder, events.schema, pattern="*.nothing")

    def fold(rows):
        return feed.with_kind(rows, KINDS).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))

    assert feed.fold_stream(stream, fold, ["user_id"]).count() == 0


def test_feed_sorting(spark):
    states = spark.createDataFrame([(1, "B", 5.0, 9), (2, "A", None, 8), (3, "A", 7.0, 7)], "id int, state string, duration double, started_at int")

    def ids(**options):
        return [r["id"] for r in feed.filter_feed(states, key="id", **options).collect()]

    assert ids() == [1, 2, 3]
    assert ids(sort="Duration") == [3, 1, 2]
    assert ids(sort="State", descending=False) == [2, 3, 1]
    assert ids(sort="Key") == [3, 2, 1]
    assert ids(min_duration=6) == [3]
    with pytest.raises(TransformError):
        feed.filter_feed(states, sort="Key")


def test_state_rules(spark):
    rows = [(1, 1, "started"), (2, 1, "failed"), (3, 1, "progress"), (1, 2, "started"), (2, 2, "failed"), (3, 2, "started")]
    df = spark.createDataFrame(rows, "at int, run int, kind string").withColumn("err", F.lit("boom"))
    got = {r["run"]: r for r in feed.latest_state(df, ["run"], ["at"], "at", "at", "err").collect()}
    assert (got[1]["state"], got[1]["completed_at"], got[1]["error"]) == ("Running", 2, "boom")
    assert (got[2]["state"], got[2]["completed_at"], got[2]["error"], got[2]["started_at"]) == ("Running", None, None, 3)
    levels = spark.createDataFrame([("x FAILED",), ("Cancelled",), ("node started",), ("ok",)], "s string")
    assert [r[0] for r in levels.select(feed.log_level(F.col("s"))).collect()] == ["Error", "Warning", "Debug", "Info"]
