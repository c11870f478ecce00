"""Bring several branches together."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concat_branches(branches: Sequence[DataFrame], number: str = "branch_no") -> DataFrame:
    """All rows, each with its branch position; absent columns become null."""
    marked = [b.withColumn(number, F.lit(i)) for i, b in enumerate(branches)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def merge_branches(branches: Sequence[DataFrame], key: str) -> DataFrame:
    """One row per key; a field takes the value of the last branch that has it.

    A null written by a later branch counts as a value. Branches are expected to
    hold one row per key.
    """
    together = concat_branches(branches, "_branch")
    fields = [c for c in dict.fromkeys(c for b in branches for c in b.columns) if c != key]
    merged = []
    for field in fields:
        owners = [i for i, b in enumerate(branches) if field in b.columns]
        writer = F.when(F.col("_branch").isin(owners), F.col("_branch"))
        merged.append(F.max_by(field, writer).alias(field))
    return together.groupBy(key).agg(*merged)


def branch_names(sources: Sequence[tuple[str | None, str | None]]) -> list[str]:
    """Names from (node, port) pairs: the port, ``node.port`` where several
    branches share a port, ``branch{i}`` where there is no port."""
    ports = Counter(port for _, port in sources if port)
    names = []
    for i, (node, port) in enumerate(sources):
        if not port:
            names.append(f"branch{i}")
        elif ports[port] > 1 and node:
            names.append(f"{node}.{port}")
        else:
            names.append(port)
    return names


def name_branches(
    branches: Sequence[DataFrame], sources: Sequence[tuple[str | None, str | None]], column: str = "branch"
) -> DataFrame:
    """:func:`concat_branches` with the branch name instead of its position."""
    names = branch_names([*sources, *[(None, None)] * (len(branches) - len(sources))])
    marked = [b.withColumn(column, F.lit(n)) for b, n in zip(branches, names)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def first_branch(branches: Sequence[DataFrame]) -> DataFrame | None:
    return branches[0] if branches else None


def last_branch(branches: Sequence[DataFrame]) -> DataFrame | None:
    return branches[-1] if branches else None


def with_branch_count(df: DataFrame, branches: Sequence[DataFrame], meta: str = "separate"):
    """``embedded`` adds the branch count to every row, ``separate`` returns it
    beside the rows, ``hidden`` leaves it out."""
    if meta == "embedded":
        return df.withColumn("count", F.lit(len(branches)))
    if meta == "hidden":
        return df
    return df, len(branches)
