"""Row positions that no single task has to count.

``row_number()`` without a partition key moves a whole table into one task, and
with a key it moves a whole group there. The helpers below sort by range, so a
hot key spreads over many partitions, and number rows by partition offsets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftframe.expressions import TransformError, mentions
from weftframe.session import scratch_path

# Rows kept per partition by a bounded top-n sort; beyond it we go by index.
TOP_N_LIMIT = 10_000
# Fixed value: the bits of ``monotonically_increasing_id`` that hold the place in a partition.
_PLACE_BITS = 33


def _keys(order_by: str | Column | Sequence[str | Column]) -> list[str | Column]:
    return list(order_by) if isinstance(order_by, (list, tuple)) else [order_by]


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` computed once, in the shared scratch folder; types that Parquet lacks go to a checkpoint."""
    spark = df.sparkSession
    types = df.schema.simpleString()
    if "void" in types or re.search(r"interval(?! (year|month|day|hour|minute|second))", types):
        scratch_path(spark, label)  # makes sure that there is a folder
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
        return df.checkpoint(eager=True)
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _by_range(df: DataFrame, order: list[str | Column]) -> DataFrame:
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def with_row_index(df: DataFrame, order_by=None, name: str = "index") -> DataFrame:
    """Add the zero-based position of each row in the given total order.

    One range sort, stored with the place of every row in its partition; then only
    the partitions' row counts are added up. Give an order without ties if the
    positions must be the same on every run. Without an order the rows are
    numbered as the scan delivers them, which costs no shuffle. The table is
    computed when this is called, and read once.
    """
    free = _free_prefix(df)
    ordered = df if order_by is None else _by_range(df, _keys(order_by))
    # partition in the upper bits, place in it in the lower ones
    kept = stored(ordered.withColumn(f"{free}at", F.monotonically_increasing_id()), "rows")
    part, place = F.shiftright(f"{free}at", _PLACE_BITS), F.col(f"{free}at").bitwiseAND((1 << _PLACE_BITS) - 1)
    sizes = kept.groupBy(part.alias("part")).agg(F.max(place).alias("last")).orderBy("part").collect()
    offsets, before = {}, 0
    for row in sizes:
        offsets[row["part"]] = before
        before += row["last"] + 1
    offset = _offset_of(kept, part, offsets, free)
    return offset.select(*[F.col(f"`{c}`") for c in df.columns], (place + F.coalesce(f"{free}before", F.lit(0))).alias(name))


def _free_prefix(df: DataFrame) -> str:
    """A beginning that no column's name has."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def _offset_of(rows: DataFrame, part: Column, offsets: dict[int, int], free: str) -> DataFrame:
    """``rows`` with the offset of their partition, null for none; one number per partition meets the rows."""
    offsets = {p: n for p, n in offsets.items() if n}
    if not offsets:
        return rows.withColumn(f"{free}before", F.lit(None).cast("long"))
    table = rows.sparkSession.createDataFrame(list(offsets.items()), f"{free}of long, {free}before long")
    return rows.join(F.broadcast(table), part == F.col(f"{free}of"), "left")


def with_group_index(df: DataFrame, keys: Sequence[str], order_by, name: str = "index") -> DataFrame:
    """Zero-based position inside each key group, for groups of any size; nulls are one key.

    One range sort over (keys, order). Every partition counts through its groups and
    reports its first and last key; only the group that goes on from the partition
    before gets an offset. So a hot key spreads over partitions, and no group has to
    meet in one place. The table is computed when this is called, and read once.
    """
    free = _free_prefix(df)
    helpers = {f"{free}key{i}": F.col(k) for i, k in enumerate(keys)}
    ordered = _by_range(df, [*[F.col(k).asc_nulls_first() for k in keys], *_keys(order_by)]).withColumns(helpers)
    first_key = len(df.columns)
    names = [f"{free}{n}" for n in ("part", "place", "in", "lead")]
    part, place, inside, lead = names
    added = f"{part} long, {place} long, {inside} long, {lead} boolean"

    def count(batches):
        number, before, last, run = TaskContext.get().partitionId(), 0, None, 0
        leading = True  # still in the partition's first group
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = batch.columns[first_key:]
            head = [c[0].as_py() for c in columns]
            same = np.ones(n, bool)
            same[0] = last is not None and all(map(_same_value, head, last))
            for column in columns:
                same[1:] &= _same_as_before(column)
            starts = np.where(same, -1, np.arange(n))
            starts = np.maximum.accumulate(starts)
            within = np.arange(n) - np.where(starts < 0, -run, starts)
            leads = np.full(n, leading)
            if leading:
                borders = np.flatnonzero(~same)
                borders = borders[borders > 0] if last is None else borders
                if len(borders):
                    leads[borders[0] :] = False
                    leading = False
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, number)), pa.array(before + np.arange(n)), pa.array(within), pa.array(leads)],
                names=[*batch.schema.names, *names],
            )
            before, run, last = before + n, int(within[-1]) + 1, [c[n - 1].as_py() for c in columns]

    schema = T.StructType([*ordered.schema.fields, *T.StructType.fromDDL(added).fields])
    kept = stored(ordered.mapInArrow(count, schema), "groups")
    ends = F.struct(*helpers) if helpers else F.lit(True)
    reports = kept.groupBy(F.col(part).alias("part")).agg(
        F.min_by(ends, place).alias("head"),
        F.max_by(ends, place).alias("tail"),
        F.max_by(F.col(inside) + 1, place).alias("run"),
        F.max_by(lead, place).alias("single"),
    )
    offsets: dict[int, int] = {}
    tail, carried = None, 0
    for row in sorted(reports.collect(), key=lambda r: r["part"]):
        goes_on = tail is not None and all(map(_same_value, *(list(x) if helpers else [x] for x in (row["head"], tail))))
        offsets[row["part"]] = carried if goes_on else 0
        carried = row["run"] + (offsets[row["part"]] if row["single"] else 0)
        tail = row["tail"]
    met = _offset_of(kept, F.col(part), offsets, free)
    index = F.col(inside) + F.when(F.col(lead), F.coalesce(f"{free}before", F.lit(0))).otherwise(0)
    return met.select(*[F.col(f"`{c}`") for c in df.columns], index.alias(name))


def _same_value(a: Any, b: Any) -> bool:
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


def _same_as_before(column: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before it; null equals null, NaN equals NaN."""
    n = len(column)
    a, b = column.slice(1), column.slice(0, n - 1)
    if pa.types.is_nested(column.type):
        values = column.to_pylist()
        return np.fromiter(map(_same_value, values[1:], values), bool, n - 1)
    same = pc.fill_null(pc.equal(a, b), False)
    same = pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(column.type):
        same = pc.or_(same, pc.and_(pc.fill_null(pc.is_nan(a), False), pc.fill_null(pc.is_nan(b), False)))
    return same.to_numpy(zero_copy_only=False)


def with_index_if_used(df: DataFrame, specs: Sequence[Any], order_by) -> tuple[DataFrame, list[str]]:
    """Add ``index`` only when one of the expressions names it."""
    if "index" in df.columns or not any(mentions(s, "index") for s in specs):
        return df, []
    if order_by is None:
        raise TransformError("an expression over 'index' needs order_by")
    return with_row_index(df, order_by, "index"), ["index"]
