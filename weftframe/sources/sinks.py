"""Writers for CSV, JSON, XML, text and table loads."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, DataFrameWriter, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftframe.expressions import TransformError, as_item, field_path
from weftframe.functions.xmltext import XML_OPTIONS
from weftframe.sources.files import encoding_name

# Names of the write modes, and compression levels with what the
# gzip writer calls them.
SAVE_MODES = {"overwrite": "overwrite", "append": "append", "createnew": "errorifexists"}
COMPRESSION_LEVELS = {
    "optimal": "DEFAULT_COMPRESSION",
    "fastest": "BEST_SPEED",
    "smallestsize": "BEST_COMPRESSION",
    "nocompression": "NO_COMPRESSION",
}


def save_mode(name: str) -> str:
    mode = SAVE_MODES.get(name.lower())
    if mode is None:
        raise TransformError(f"unknown write mode '{name}'")
    return mode


def _compressed(writer: DataFrameWriter, compression: str, level: str) -> DataFrameWriter:
    name = COMPRESSION_LEVELS.get(level.lower())
    if name is None:
        raise TransformError(f"unknown compression level '{level}'")
    return writer.option("compression", compression).option("zlib.compress.level", name)


def write_csv(
    df: DataFrame,
    path: str,
    include_header: bool = True,
    delimiter: str = ",",
    encoding: str | None = None,
    mode: str = "overwrite",
    compression: str = "none",
    level: str = "optimal",
) -> None:
    """CSV parts; null is an empty cell."""
    (
        _compressed(df.write.mode(save_mode(mode)), compression, level)
        .option("header", include_header)
        .option("sep", delimiter)
        .option("encoding", encoding_name(encoding))
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_json(
    df: DataFrame,
    path: str,
    encoding: str | None = None,
    mode: str = "overwrite",
    compression: str = "none",
    level: str = "optimal",
) -> None:
    """JSON lines with nulls written out."""
    writer = _compressed(df.write.mode(save_mode(mode)), compression, level).option("ignoreNullFields", False)
    writer.option("encoding", encoding_name(encoding)).json(path)


def write_xml(
    df: DataFrame,
    path: str,
    root_element: str = "root",
    row_element: str = "row",
    mode: str = "overwrite",
    rows_per_file: int = 50_000,
) -> None:
    """XML parts of at most ``rows_per_file`` rows: Spark cannot split an XML file, so one task reads it whole."""
    (
        df.write.format("xml")
        .mode(save_mode(mode))
        .options(**XML_OPTIONS)
        .option("maxRecordsPerFile", rows_per_file)
        .option("rootTag", root_element)
        .option("rowTag", row_element)
        .save(path)
    )


def write_text(
    df: DataFrame,
    column: str,
    path: str,
    mode: str = "overwrite",
    compression: str = "none",
    level: str = "optimal",
) -> None:
    """One line per row."""
    _compressed(df.select(column).write.mode(save_mode(mode)), compression, level).text(path)


def compressed_size(df: DataFrame, path: str) -> DataFrame:
    """Files and bytes below a written path."""
    files = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def load_frame(
    df: DataFrame,
    target: T.StructType,
    column_mapping: Mapping[str, str] | None = None,
    on_error: str = "fail",
) -> DataFrame:
    """Shape rows for a table: mapped names, absent columns null, typed values."""
    back = {to: source for source, to in (column_mapping or {}).items()}
    columns = []
    for field in target.fields:
        source = back.get(field.name, field.name)
        found = field_path(df, source)
        if found is None:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        attempt = found.try_cast(field.dataType)
        if on_error == "null":
            columns.append(attempt.alias(field.name))
            continue
        complaint = F.raise_error(
            F.concat(F.lit(f"column '{field.name}': bad value '"), found.cast("string"), F.lit("'"))
        ).cast(field.dataType)
        columns.append(F.coalesce(attempt, F.when(found.isNotNull(), complaint)).alias(field.name))
    return as_item(df).select(*columns)


def bulk_load(
    df: DataFrame,
    target: T.StructType,
    path: str | None = None,
    jdbc: Mapping[str, Any] | None = None,
    column_mapping: Mapping[str, str] | None = None,
    batch_size: int = 1000,
) -> int:
    """Append rows to a parquet table path or a JDBC table; returns the count."""
    seen = Observation("loaded")
    rows = load_frame(df, target, column_mapping).observe(seen, F.count(F.lit(1)).alias("rows"))
    if path is not None:
        rows.write.mode("append").parquet(path)
    elif jdbc is not None:
        rows.write.format("jdbc").mode("append").options(**jdbc).option("batchsize", batch_size).save()
    else:
        raise TransformError("bulk_load needs a path or jdbc options")
    return int(seen.get["rows"])


