"""Table metadata, SQL types and generated sample values."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftframe.expressions import TransformError

# Database type names and their Spark types.
SQL_TYPES = {
    "int": T.IntegerType(),
    "int4": T.IntegerType(),
    "integer": T.IntegerType(),
    "serial": T.IntegerType(),
    "smallint": T.ShortType(),
    "int2": T.ShortType(),
    "bigint": T.LongType(),
    "int8": T.LongType(),
    "bigserial": T.LongType(),
    "text": T.StringType(),
    "varchar": T.StringType(),
    "character varying": T.StringType(),
    "char": T.StringType(),
    "character": T.StringType(),
    "nvarchar": T.StringType(),
    "clob": T.StringType(),
    "uuid": T.StringType(),
    "bool": T.BooleanType(),
    "boolean": T.BooleanType(),
    "real": T.DoubleType(),
    "float4": T.DoubleType(),
    "float8": T.DoubleType(),
    "double": T.DoubleType(),
    "double precision": T.DoubleType(),
    "numeric": T.DecimalType(38, 18),
    "decimal": T.DecimalType(38, 18),
    "money": T.DecimalType(38, 18),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "timestamp without time zone": T.TimestampNTZType(),
    "datetime": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(),
    "timestamp with time zone": T.TimestampType(),
    "time": T.DayTimeIntervalType(),
    "interval": T.DayTimeIntervalType(),
    "bytea": T.BinaryType(),
    "blob": T.BinaryType(),
}


def spark_type(sql_type: str | None, strict: bool = False) -> T.DataType:
    """Spark type of a database type name; ``numeric(p,s)`` keeps p and s."""
    token = (sql_type or "").strip().lower()
    base, _, rest = token.partition("(")
    known = SQL_TYPES.get(base.strip())
    if known is None:
        if strict:
            raise TransformError(f"unknown SQL type '{sql_type}'")
        warnings.warn(f"unknown SQL type '{sql_type}' read as string", stacklevel=2)
        return T.StringType()
    if isinstance(known, T.DecimalType) and rest:
        digits = [int(d) for d in rest.rstrip(") ").split(",")]
        return T.DecimalType(digits[0], digits[1] if len(digits) > 1 else 0)
    return known


def import_catalog(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column: table, column, position, type, nullable."""
    rows = [
        (name, f.name, i, f.dataType.simpleString(), f.nullable)
        for name, df in sorted(tables.items())
        for i, f in enumerate(df.schema.fields)
    ]
    schema = "table_name string, column_name string, position int, data_type string, nullable boolean"
    return spark.createDataFrame(rows, schema)


def session_tables(spark: SparkSession, pattern: str | None = None) -> dict[str, DataFrame]:
    """Tables and views of the current database, by name; ``pattern`` such as ``sales_*`` chooses some."""
    return {t.name: spark.table(t.name) for t in spark.catalog.listTables(pattern=pattern)}


def sample_value(dtype: T.DataType, index: Column) -> Column:
    """The generated value of a type for a zero-based row index."""
    number = index + 1
    day = F.lit("2026-01-01").cast("date")
    if isinstance(dtype, T.StringType):
        return F.concat(F.lit("sample-"), index.cast("string"))
    if isinstance(dtype, T.IntegralType):
        return number.cast(dtype)
    if isinstance(dtype, (T.DecimalType, T.DoubleType, T.FloatType)):
        return (number + F.lit(0.5)).cast(dtype)
    if isinstance(dtype, T.BooleanType):
        return index % 2 == 0
    if isinstance(dtype, T.DateType):
        return F.date_add(day, index.cast("int"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_add(day, index.cast("int")).cast(dtype)
    if isinstance(dtype, T.DayTimeIntervalType):
        return F.make_dt_interval(hours=number.cast("int"))
    if isinstance(dtype, T.BinaryType):
        return F.unhex(F.lpad(F.hex(number % 256), 2, "0"))
    return F.lit(None).cast(dtype)


def sample_rows(spark: SparkSession, schema: T.StructType, count: int) -> DataFrame:
    """``count`` generated rows of a schema."""
    return sample_columns(spark.range(count), schema, F.col("id"))


def sample_columns(df: DataFrame, schema: T.StructType, index: Column) -> DataFrame:
    """Generated values for every row of ``df``, numbered by ``index``."""
    return df.select(*[sample_value(f.dataType, index).alias(f.name) for f in schema.fields])


def read_database(
    spark: SparkSession, options: Mapping[str, str], query: str, split: Mapping[str, str] | None = None
) -> DataFrame:
    """A query against an external database; filters and columns are pushed down.

    ``split`` (partitionColumn, lowerBound, upperBound, numPartitions) reads in
    parallel; without it the rows come through one task.
    """
    reader = spark.read.format("jdbc").options(**options)
    if split is None:
        return reader.option("query", query).load()
    return reader.option("dbtable", f"({query}) q").options(**split).load()
