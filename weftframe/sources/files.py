"""Scans of CSV, JSON, XML, text, binary, archives and listings."""

from __future__ import annotations

import gzip
import io
import os
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftframe.expressions import TransformError, quoted
from weftframe.functions.xmltext import XML_OPTIONS, xml_path

# Accepted encoding names and what Spark calls them.
ENCODINGS = {
    "utf8": "UTF-8",
    "utf-8": "UTF-8",
    "utf16": "UTF-16LE",
    "utf-16": "UTF-16LE",
    "utf-16le": "UTF-16LE",
    "unicode": "UTF-16LE",
    "utf-16be": "UTF-16BE",
    "ascii": "US-ASCII",
    "us-ascii": "US-ASCII",
    "latin1": "ISO-8859-1",
    "latin-1": "ISO-8859-1",
    "iso-8859-1": "ISO-8859-1",
}
_SPARE_CELLS = 16


def encoding_name(name: str | None) -> str:
    if not name or not name.strip():
        return "UTF-8"
    return ENCODINGS.get(name.strip().lower(), name.strip())


def read_csv(
    spark: SparkSession,
    path: str,
    has_header: bool = True,
    delimiter: str = ",",
    encoding: str | None = None,
    skip_empty_rows: bool = True,
    extra_columns: int | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """CSV as text columns: nothing is inferred, empty cells are null.

    Cells beyond the header go to ``column{i}``. How many such columns there
    are is found by one pass over the files unless ``extra_columns`` says so.
    Set ``multi_line=False`` for files without quoted line breaks: Spark then
    splits large files.
    """
    options = {
        "sep": delimiter,
        "encoding": encoding_name(encoding),
        "multiLine": str(multi_line).lower(),
        "quote": '"',
        "escape": '"',
        "emptyValue": "",
        "mode": "PERMISSIVE",
    }
    reader = spark.read.options(**options)
    first = reader.option("header", has_header).csv(path).columns
    names = list(first) if has_header else [f"column{i}" for i in range(len(first))]
    spare = _SPARE_CELLS if extra_columns is None else extra_columns
    while True:
        columns = names + [f"column{i}" for i in range(len(names), len(names) + spare)]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        rows = reader.option("header", has_header).schema(schema).csv(path)
        if extra_columns is not None:
            break
        used = _widest(rows, columns[len(names):])
        if used < spare:
            return read_csv(
                spark, path, has_header, delimiter, encoding, skip_empty_rows, used, multi_line
            )
        spare *= 4
    if skip_empty_rows:
        empty = F.lit(True)
        for c in columns:
            empty = empty & (F.col(quoted(c)).isNull() | (F.col(quoted(c)) == ""))
        rows = rows.where(~empty)
    return rows


def _widest(rows: DataFrame, spare: list[str]) -> int:
    """How many of the spare columns hold anything, counted to the last one."""
    position = F.greatest(
        F.lit(0), F.lit(0), *[F.when(F.col(quoted(c)).isNotNull(), F.lit(i + 1)) for i, c in enumerate(spare)]
    )
    return rows.agg(F.coalesce(F.max(position), F.lit(0)).alias("n")).first()["n"]


def read_json(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    schema: T.StructType | str | None = None,
    ragged: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """JSON files: an array root gives a row per element, an object root one.

    ``ragged`` keeps every record in a VARIANT column ``item``;
    ``multi_line=False`` reads JSON lines, which Spark can split.
    """
    reader = spark.read.option("multiLine", multi_line)
    if encoding is not None:
        reader = reader.option("encoding", encoding_name(encoding))
    if ragged:
        roots = reader.option("singleVariantColumn", "item").json(path)
        elements = F.coalesce(F.try_variant_get("item", "$", "array<variant>"), F.array("item"))
        return roots.select(F.explode(elements).alias("item"))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_xml(
    spark: SparkSession,
    path: str,
    row_tag: str,
    encoding: str | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """One row per ``row_tag`` element; all values are text."""
    reader = spark.read.format("xml").options(**XML_OPTIONS).option("rowTag", row_tag)
    reader = reader.option("encoding", encoding_name(encoding))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_xml_nodes(spark: SparkSession, path: str, xpath: str, max_size: int | None = None) -> DataFrame:
    """The text of every node at an XPath, one row per node and file. A file is
    read whole by one task; ``max_size`` bounds it."""
    whole = read_whole_text(spark, path, max_size)
    return whole.select("path", F.explode(xml_path(F.col("content"), xpath)).alias("value"))


def read_xml_checked(spark: SparkSession, path: str, row_tag: str, xsd: str, schema: T.StructType) -> DataFrame:
    """As :func:`read_xml`, each row checked against an XSD.

    The raw text of rows that violate it is in ``_corrupt_record``.
    """
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    spark.sparkContext.addFile(xsd)
    return (
        spark.read.format("xml")
        .options(**XML_OPTIONS)
        .option("rowTag", row_tag)
        .option("rowValidationXSDPath", os.path.basename(xsd))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .schema(wide)
        .load(path)
    )


def read_lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """One row per line in ``value``; large files are split."""
    charset = encoding_name(encoding)
    if charset == "UTF-8":
        return spark.read.text(path)
    # The text source splits at the encoded line feed and hands on raw bytes.
    raw = spark.read.option("encoding", charset).option("lineSep", "\n").text(path)
    decoded = F.decode(F.col("value").cast("binary"), charset)
    return raw.select(F.regexp_replace(decoded, "\r$", "").alias("value"))


def read_whole_text(
    spark: SparkSession, path: str, max_size: int | None = None, encoding: str | None = None
) -> DataFrame:
    """One row per file: ``path, content, size, lastModified``.

    A file above ``max_size`` is an error before any content is read.
    """
    files = read_binary(spark, path, max_size)
    return files.select("path", F.decode("content", encoding_name(encoding)).alias("content"), "size", "lastModified")


def read_binary(spark: SparkSession, path: str, max_size: int | None = None) -> DataFrame:
    """One row per file with its bytes, size and time of change.

    With ``max_size`` the sizes are looked at first, in a pass that reads no
    content; a larger file is an error that names it. No file is ever left out.
    """
    files = spark.read.format("binaryFile").load(path)
    if max_size is not None:
        large = files.where(F.col("length") > max_size).select("path", "length").first()
        if large is not None:
            raise TransformError(f"{large['path']} has {large['length']} bytes, more than {max_size}")
    return files.select(
        "path", "content", F.col("length").alias("size"), F.col("modificationTime").alias("lastModified")
    )


def list_files(
    spark: SparkSession, path: str, pattern: str | None = None, prefix: str | None = None, max_keys: int | None = None
) -> DataFrame:
    """The files below a folder in key order, unread.

    A key is the file's path below the folder; ``prefix`` is compared with the
    whole key. With ``max_keys`` only so many come, and ``truncated`` tells
    whether there are more.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    root = re.sub("^file:/*", "/", path).rstrip("/") + "/"
    listed = reader.load(path)
    key = F.expr("substring(path, locate(root, path) + length(root))")
    files = listed.withColumn("root", F.lit(root)).select(
        key.alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("lastModified")
    )
    if prefix:
        files = files.where(F.col("key").startswith(prefix))
    ordered = files.orderBy("key")
    if max_keys is None:
        return ordered
    return ordered.limit(max_keys).withColumn("truncated", F.lit(files.count() > max_keys))


# --- archives ----------------------------------------------------------------

# Members are handed on in batches of at most this many rows or bytes.
_BATCH_MEMBERS = 1000
_BATCH_BYTES = 8 * 1024 * 1024
ARCHIVE_SCHEMA = "archive string, member string, size bigint, content binary, unsafe boolean"


def archive_format(path: str) -> str:
    """zip, tar, targz or gzip (a single file), by extension."""
    lowered = path.lower()
    if lowered.endswith((".tar.gz", ".tgz")):
        return "targz"
    if lowered.endswith(".tar"):
        return "tar"
    if lowered.endswith(".zip"):
        return "zip"
    if lowered.endswith(".gz"):
        return "gzip"
    raise TransformError(f"cannot tell the archive format of '{path}'")


def escapes_root(member: str) -> bool:
    """Whether extracting the member would leave the target folder."""
    name = member.replace("\\", "/")
    if name.startswith("/") or (len(name) > 1 and name[1] == ":"):
        return True
    depth = 0
    for part in name.split("/"):
        depth += -1 if part == ".." else (0 if part in ("", ".") else 1)
        if depth < 0:
            return True
    return False


def _bounded(reader, member: str, most: int | None) -> bytes:
    """What a reader gives; more than ``most`` bytes are an error, not a full memory."""
    body = reader.read() if most is None else reader.read(most + 1)
    if most is not None and len(body) > most:
        raise TransformError(f"member '{member}' has more than {most} bytes")
    return body


def _members(path: str, content: bytes, kind: str | None, most: int | None) -> Iterator[tuple[str, bytes]]:
    kind = kind or archive_format(path)
    if kind == "gzip":
        name = path.rpartition("/")[2].removesuffix(".gz")
        with gzip.GzipFile(fileobj=io.BytesIO(content)) as reader:
            yield name, _bounded(reader, name, most)
        return
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for info in archive.infolist():
                if info.is_dir():
                    continue
                if escapes_root(info.filename):
                    yield info.filename, b""
                else:
                    with archive.open(info) as reader:
                        yield info.filename, _bounded(reader, info.filename, most)
        return
    mode = {"targz": "r:gz", "tar": "r:"}.get(kind)
    if mode is None:
        raise TransformError(f"unknown archive format '{kind}'")
    with tarfile.open(fileobj=io.BytesIO(content), mode=mode) as archive:
        for info in archive:
            if info.isfile():
                reader = archive.extractfile(info)
                unsafe = escapes_root(info.name) or reader is None
                yield info.name, b"" if unsafe else _bounded(reader, info.name, most)


def unpack_archives(archives: DataFrame, kind: str | None = None, max_member: int | None = None) -> DataFrame:
    """One row per member of the archives in ``path, content``.

    ``kind`` overrides the extension. A member above ``max_member`` bytes fails the
    job with its name.

    Members that would escape the target folder come empty and ``unsafe``.
    """

    names = ["archive", "member", "size", "content", "unsafe"]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for archive, content in zip(batch["path"], batch["content"]):
                for member, body in _members(archive, content, kind, max_member):
                    held.append((archive, member, len(body), body, escapes_root(member)))
                    size += len(body)
                    if size > _BATCH_BYTES or len(held) >= _BATCH_MEMBERS:
                        yield pd.DataFrame(held, columns=names)
                        held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=names)

    return archives.select("path", "content").mapInPandas(unpack, ARCHIVE_SCHEMA)


def read_archives(
    spark: SparkSession, path: str, max_size: int | None = None, kind: str | None = None, max_member: int | None = None
) -> DataFrame:
    """Members of the archive files at a path."""
    return unpack_archives(read_binary(spark, path, max_size), kind, max_member)
