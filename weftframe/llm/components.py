"""Connected components of a link table, as rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftframe.llm.common import discard, written


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long); component = smallest node.

    Alternates two star steps: each node hands its larger neighbours, then its
    smaller ones, to the smallest node it knows. Either step makes one link of each link,
    so rows never outnumber the links, and takes one join of the links with a minimum per node.
    The number of rounds grows with the logarithm of a component's size; links
    that all lead to the smallest node of their component, as those of earlier groups, need none.
    Every step is written to the shared scratch folder, so lost executors cost
    one step at most. Null ends and self links are ignored; no links, no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = written(edges, "links")
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
        # settled: a node with a smaller one has no other
        if low.where("m < u AND m < most").isEmpty():
            break
        least = low.select(F.col("u").alias("v"), F.least("m", "u").alias("m"))
        last, large = edges, written(edges.join(least, "v").select("u", F.col("m").alias("v")), "links")
        discard(last)
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        # the link to the smallest node stays, each other end is handed to it
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small, "links")
        discard(large)
    else:
        raise RuntimeError("components did not settle")
    named = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
