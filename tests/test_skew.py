"""One key holds a third of the rows: no partition may hold all of it."""

import pytest
from pyspark.sql import functions as F

from weftframe.operators.aggregating import aggregate
from weftframe.operators.history import latest_per_key
from weftframe.operators.indexing import with_group_index, with_row_index
from weftframe.operators.joining import join_tables
from weftframe.operators.querying import sort_rows

ROWS = 120_000


@pytest.fixture(scope="module")
def skewed(spark):
    """Rows of which every third has the key 0, the others keys of their own."""
    return spark.range(0, ROWS, 1, 12).select(
        F.expr("if(id % 3 = 0, 0, id)").alias("k"),
        F.expr("cast(pmod(id * 7919, 1009) as double)").alias("v"),
        F.col("id").alias("at"),
    )


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def largest_share(df):
    """Part of the rows in the fullest partition."""
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return max(sizes) / sum(sizes)


def test_row_numbers_spread_a_hot_key(skewed, uncoalesced):
    assert largest_share(with_row_index(skewed, ["k", "at"])) < 0.15


def test_sorting_on_a_hot_key_spreads_it(skewed, uncoalesced):
    assert largest_share(sort_rows(skewed, "k")) < 0.15


def test_group_numbers_of_a_hot_key(skewed):
    numbered = with_group_index(skewed, ["k"], ["at"])
    assert numbered.where("k = 0").agg(F.max("index")).first()[0] == ROWS // 3 - 1
    assert numbered.where("k = 0 and index <> at / 3").count() == 0
    assert numbered.where("k <> 0 and index <> 0").count() == 0


def shuffled_rows(df):
    """Rows written by every shuffle of a plan that has run."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    found = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            walk(node.executedPlan())
            return
        if name.endswith("QueryStage"):
            walk(node.plan())
            return
        if name == "Exchange":
            metric = node.metrics().get("shuffleRecordsWritten")
            if metric.isDefined():
                found.append(metric.get().value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_latest_row_of_a_hot_key_shuffles_one_row_per_task(skewed):
    newest = latest_per_key(skewed.where("k = 0"), ["k"], ["at"])
    assert newest.first()["at"] == ROWS - 3
    assert max(shuffled_rows(newest)) <= 12


def test_grouping_a_hot_key_shuffles_one_row_per_task(skewed):
    for operation in ("count", "sum", "min", "first"):
        one = aggregate(skewed.where("k = 0"), operation, "v", group_by="k", order_by=["at"])
        assert max(shuffled_rows(one)) <= 12


def test_median_of_a_hot_key_ranks_few_rows(skewed):
    import statistics

    hot = skewed.where("k = 0")
    median = aggregate(hot, "median", "at", group_by="k")
    assert median.first()["result"] == statistics.median(range(0, ROWS, 3))
    # the last shuffle carries the bracket only, not the 40,000 rows
    assert min(shuffled_rows(median)) <= 40


def test_unmatched_counts_of_a_hot_key(spark, skewed):
    right = spark.range(0, 10).select(F.lit(0).alias("k"), F.col("id").alias("b"))
    joined = join_tables(skewed, right, "k", "k")
    counts = joined.unmatched().first()
    assert (counts["unmatchedLeft"], counts["unmatchedRight"]) == (ROWS - ROWS // 3, 0)
    assert join_tables(skewed, right, "k", "k", "full").result.count() == ROWS - ROWS // 3 + 10 * (ROWS // 3)


def test_a_skewed_join_is_split(spark, skewed):
    """Without a broadcast, adaptive execution splits the hot partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        right = spark.range(0, ROWS, 1, 4).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("b"))
        for how in ("inner", "left", "full"):
            joined = join_tables(skewed, right, "k", "k", how, {"at": "left.at", "b": "right.b"}).result
            joined.collect()
            assert "SortMergeJoin(skew=true)" in joined._jdf.queryExecution().executedPlan().toString(), how
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
