"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftframe.session import scratch_path

# Fixed value: the white space that separates words (blank, tab to carriage return).
WORD_GAPS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a folder in any store Spark reads."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder: computed once, lineage cut."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def settled(df: DataFrame, label: str) -> DataFrame:
    """``written``, and the collector lets Spark remove the shuffle files of the step, and what the driver kept of it, at once."""
    table = written(df, label)
    df.sparkSession.sparkContext._jvm.System.gc()
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by ``written`` that nothing reads any more; others are left alone.

    The collector then lets Spark remove the shuffle files of the steps that made them.
    """
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path is None:
            continue
        jvm = table.sparkSession.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        table._scratch = None
        jvm.System.gc()


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Run ``fn`` over column lists of each Arrow batch; texts come as UTF-8 bytes."""
    spark = df.sparkSession
    fields = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(fields)

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            columns = {}
            for name, column in zip(batch.schema.names, batch.columns):
                if pa.types.is_string(column.type):
                    column = column.cast(pa.binary())
                elif pa.types.is_large_string(column.type):
                    column = column.cast(pa.large_binary())
                columns[name] = column.to_pylist()
            out = fn(columns)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, fields)


def has_letter(column) -> Column:
    """True where a text holds a letter of any script."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).rlike("\\p{L}")


@contextmanager
def uncollected():
    """Without Python's cycle collector: for code that makes no cycles beside large tables of known words,
    which the collector would walk through again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def hash_sample(df: DataFrame, column: str, rows: int, total: int) -> DataFrame:
    """About the first ``rows`` rows in the order of a hash of ``column``, out of ``total``.

    A bound on the hash leaves some four times as many before the sort, so tasks hand
    on few rows however many there are.
    """
    key = F.xxhash64(column)
    if total > 4 * rows:
        df = df.where(key < -(1 << 63) + int(4 * rows / total * (1 << 64)))
    return df.orderBy(key, column).limit(rows)


def vocabulary(name: str) -> str:
    """Where the installed public vocabulary file of that name lies; the same on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)
