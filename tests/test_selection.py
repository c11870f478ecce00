"""The median by selection, on values that are hard to cut into equal steps."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from weftframe.operators import aggregating
from weftframe.operators.aggregating import aggregate

INF = math.inf
r = random.Random(8)
SERIES = {
    "spread": [10.0 ** r.uniform(-300, 300) * r.choice([-1, 1]) for _ in range(301)],
    "ties": [float(r.randint(0, 3)) for _ in range(400)],
    "ends": [-INF] * 3 + [1.0, 2.0] + [INF] * 3,
    "all infinite": [-INF, INF, INF],
    "close": [1.0 + i * 2**-52 for i in range(64)],
    "tiny": [5e-324 * i for i in range(20)],
    "wide": [-1.7e308, 1.7e308, 1.0, 2.0],
    "one": [4.5],
    "pair": [1.0, 2.0],
}


@pytest.mark.parametrize("accuracy, steps", [(100_000, 1_024), (10, 4)])
def test_median_by_selection(spark, monkeypatch, accuracy, steps):
    monkeypatch.setattr(aggregating, "MEDIAN_ACCURACY", accuracy)
    monkeypatch.setattr(aggregating, "MEDIAN_STEPS", steps)
    rows = [(k, v) for k, values in SERIES.items() for v in values] + [("none", None), (None, 3.0), (None, None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {x["key"]: (x["result"], x["count"]) for x in aggregate(df, "median", "v", "k").collect()}
    want = {k: (statistics.median(v), len(v)) for k, v in SERIES.items()} | {"none": (None, 1), None: (3.0, 2)}
    assert got == want


def test_nan_sorts_last(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (math.nan,)], "v double")
    assert aggregate(df, "median", "v").first()["result"] == 2.0
    assert math.isnan(aggregate(df.union(df.where(F.isnan("v"))), "median", "v").where(F.isnan("result")).count() and math.nan)


def test_no_window_and_no_gathering_of_values(spark):
    df = spark.range(1_000).select((F.col("id") % 7).alias("k"), F.col("id").cast("double").alias("v"))
    for result in (aggregate(df, "median", "v"), aggregate(df, "median", "v", "k")):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Sort " not in plan
