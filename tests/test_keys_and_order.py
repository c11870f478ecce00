"""Null keys, repeated changes, numbering over partition borders, long numbers, dates, patterns, table feeds."""

import shutil

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftframe.expressions import loose_key
from weftframe.functions import dates, jsontext
from weftframe.operators import history
from weftframe.operators.indexing import with_group_index, with_row_index
from weftframe.streaming import feed


@pytest.fixture
def many_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


KEYS = {
    "hot": "if(id % 3 = 0, null, if(id % 3 = 1, 7, id))",
    "text": "if(id % 4 = 0, null, concat('k', id % 5))",
    "double": "if(id % 2 = 0, double('NaN'), if(id % 5 = 0, -0.0D, 0.0D))",
    "struct": "struct(id % 3 as a, if(id % 2 = 0, null, 'x') as b)",
    "one": "'same'",
}


@pytest.mark.parametrize("kind", sorted(KEYS))
def test_group_numbers_over_borders(spark, many_parts, kind):
    df = spark.range(0, 5_000, 1, 7).select(F.expr(KEYS[kind]).alias("k"), F.expr("(id * 7919) % 5000").alias("o"), F.lit(1).alias("_in"))
    got = with_group_index(df, ["k"], ["o"])
    assert got.columns == ["k", "o", "_in", "index"] and got.count() == 5_000
    want = df.selectExpr("k", "o", "row_number() over (partition by k order by o) - 1 as want")
    wrong = got.join(want, "o").where("index <> want").count()
    assert wrong == 0


def test_numbering_reads_once_and_sorts_once(spark, many_parts):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    df = spark.range(0, 3_000, 1, 6).mapInArrow(counted, "id long").withColumn("k", F.col("id") % 3)
    plan = with_group_index(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    # the sort itself ran before; what is left is a scan and one number per partition
    assert "Exchange rangepartitioning" not in plan and "Exchange hashpartitioning" not in plan and "Window" not in plan
    # Spark looks at the keys once more to find the ranges
    assert reads.value <= 6_000


def test_numbers_of_odd_types_and_empty_tables(spark):
    df = spark.sql("select id, null as nothing, interval 1 month as i, parse_json('{\"a\":1}') as v from range(10)")
    assert sorted(r["index"] for r in with_row_index(df, F.desc("id")).select("index").collect()) == list(range(10))
    assert with_row_index(df.where("false"), "id").count() == 0
    assert with_group_index(df.select("id").where("false"), ["id"], ["id"]).count() == 0


def test_null_keys_are_keys(spark):
    past = spark.createDataFrame([(None, 5), ("a", 2)], "k string, version long")
    new = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4)], "k string, at long")
    got = history.next_versions(past, new, ["k"], ["at"])
    assert {(r["k"], r["at"], r["version"]) for r in got.collect()} == {(None, 1, 6), (None, 2, 7), ("a", 3, 3), ("b", 4, 1)}
    target = spark.createDataFrame([(None, "old", 1), ("a", "old", 2)], "k string, s string, at long")
    incoming = spark.createDataFrame([(None, "new", 9), ("c", "new", 8)], "k string, s string, at long")
    merged = history.upsert(target, incoming, ["k"], ["s"], ["at"])
    assert {tuple(r) for r in merged.collect()} == {(None, "new", 1), ("a", "old", 2), ("c", "new", 8)}
    changed = history.update_by_key(target, incoming.select("k", "s"), ["k"], ["s"])
    assert {tuple(r) for r in changed.collect()} == {(None, "new", 1), ("a", "old", 2)}
    assert history.affected_rows(target, incoming, ["k"]).first()["affected"] == 1


def test_two_changes_of_a_key_are_an_error(spark):
    target = spark.createDataFrame([("a", "old")], "k string, s string")
    twice = spark.createDataFrame([("a", "x"), ("a", "y")], "k string, s string")
    with pytest.raises(PySparkException, match="several changes"):
        history.update_by_key(target, twice, ["k"], ["s"]).collect()


SAME = [
    ["1", "1.0", "+01", "1e0", "10e-1", " 1 "],
    ["123456789012345678901", "123456789012345678901.000", "1.23456789012345678901e20"],
    ["123456789012345678902"],
    ["0.1234567890123456789012345", ".1234567890123456789012345"],
    ["-0", "0", "0.00", "0e5"],
    ["-2.50", "-25e-1"],
    ["1e25", "10000000000000000000000000"],
]


def test_numbers_of_any_length_keep_their_digits(spark):
    df = spark.createDataFrame([(i, s) for i, group in enumerate(SAME) for s in group], "i int, s string")
    keys = {}
    for row in df.select("i", loose_key(F.col("s"), df.schema["s"].dataType).alias("k")).collect():
        keys.setdefault(row["i"], set()).add(row["k"])
    assert all(len(k) == 1 for k in keys.values()) and len(set.union(*keys.values())) == len(SAME)
    typed = spark.sql("select 1e25D as d, 1L as l, cast(1.0 as decimal(10,3)) as c, cast(0.5 as float) as f, cast(12345678901234567890.5 as decimal(30,5)) as w")
    got = typed.select(*[loose_key(F.col(c), typed.schema[c].dataType).alias(c) for c in typed.columns]).first()
    assert tuple(got) == ("n:1" + "0" * 25, "n:1", "n:1", "n:0.5", "n:12345678901234567890.5")


@pytest.mark.parametrize(
    "text, pattern, want",
    [
        ("2024-03-02T03:04:05.1234567+05:00", "HH:mm:ss.ffff zzz", "03:04:05.1234 +05:00"),
        ("2024-03-02T03:04:05.1234567+05:00", "fffffff fffff f z zz", "1234567 12345 1 +5 +05"),
        ("2024-03-02T15:04:05.5Z", "h:mm t tt FFF K", "3:04 P PM 5 +00:00"),
        ("2024-03-02T15:04:05-03:30", "yyy-M-d g 'at' \\h%H", "2024-3-2 A.D. at h15"),
        ("2024-03-02T23:30:00-03:30", "u", "2024-03-03 03:00:00Z"),
        ("2024-03-02T23:30:00-03:30", "R", "Sun, 03 Mar 2024 03:00:00 GMT"),
        ("2024-03-02T23:30:00-03:30", "o", "2024-03-02T23:30:00.0000000-03:30"),
        ("2024-03-02", "dddd d MMMM", "Saturday 2 March"),
        ("2024-03-02 01:02", "D", "Saturday, 02 March 2024"),
    ],
)
def test_dates_in_their_own_offset(spark, text, pattern, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(dates.format_datetime(F.col("s"), pattern)).first()[0] == want


@pytest.mark.parametrize(
    "text, pattern, want",
    [
        ("k=;", "k=(?<value>[a-z]*)(?:;|,)", ""),
        ("k=;", "k=(?:(?<value>[a-z]+)|;)", "k=;"),
        ("k=; k=a", "k=(?<value>[a-z])?", "k="),
        ("k=; k=a", "k=(?<value>[a-z]*)", ""),
        ("xx k=ab;", "(?i)K=(?<value>[a-z]+)", "ab"),
        ("ab", "(x)?(?<value>)b", ""),
        ("ab", "z(?<value>.)", None),
        ("ab", "(", None),
    ],
)
def test_value_groups(spark, text, pattern, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(*jsontext.extract_patterns(F.col("s"), {"v": pattern})).first()["v"] == want


def test_a_feed_reads_its_own_table_only(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    shutil.copy(f"{small}/events.parquet", tmp_path / "events.parquet")
    shutil.copy(f"{small}/events.parquet", tmp_path / "events.parquet_old")
    events.repartition(3).write.parquet(f"{tmp_path}/parts.parquet")
    events.write.parquet(f"{tmp_path}/parts.parquet_old")
    for name in ("events.parquet", "parts.parquet"):
        stream = feed.read_table_feed(spark, f"{tmp_path}/{name}")
        counted = feed.fold_stream(stream, lambda s: s.groupBy("event_type").agg(F.count("*").alias("n")), ["event_type"])
        assert counted.agg(F.sum("n")).first()[0] == events.count()
