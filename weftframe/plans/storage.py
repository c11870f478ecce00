"""Queries over scans and sinks: tables are written out and read back."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftframe.operators.routing import run_sql
from weftframe.expressions import TransformError
from weftframe.plans.registry import query
from weftframe.session import scratch_path
from weftframe.sources import catalog, files, sinks

PART_TEXT = """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand,
                      CASE WHEN p_size > 25 THEN p_type END AS p_type FROM part"""


def _parts(t):
    return t.part.select(
        "p_partkey", "p_name", "p_brand", F.when(F.col("p_size") > 25, F.col("p_type")).alias("p_type")
    )


@query("csv_scan", PART_TEXT.replace("p_name,", "p_name || ', \"n\"' || chr(10) AS p_name,"))
def csv_scan(spark, t):
    path = scratch_path(spark, "csv")
    rows = _parts(t).withColumn("p_name", F.concat("p_name", F.lit(', "n"\n')))
    sinks.write_csv(rows, path, delimiter=";", encoding="utf-16")
    return files.read_csv(spark, path, delimiter=";", encoding="utf-16")


@query("csv_roundtrip", PART_TEXT)
def csv_roundtrip(spark, t):
    path = scratch_path(spark, "csv")
    sinks.write_csv(_parts(t), path)
    return files.read_csv(spark, path, multi_line=False, extra_columns=0)


@query(
    "csv_headerless",
    """SELECT CAST(l_orderkey AS VARCHAR) AS column0, l_returnflag AS column1, l_linestatus AS column2 FROM lineitem""",
)
def csv_headerless(spark, t):
    path = scratch_path(spark, "csv")
    sinks.write_csv(t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus"), path, include_header=False)
    return files.read_csv(spark, path, has_header=False, multi_line=False)


@query("json_scan", "SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN p_type END AS p_type FROM part")
def json_scan(spark, t):
    """Each file holds one JSON array per line group; the root is unrolled."""
    path = scratch_path(spark, "json")
    documents = _parts(t).select(F.to_json(F.array(F.struct("p_partkey", "p_name", "p_type"))).alias("value"))
    sinks.write_text(documents, "value", path)
    schema = "p_partkey long, p_name string, p_type string"
    return files.read_json(spark, path, schema=schema, multi_line=False)


@query(
    "json_ragged",
    "SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_type END AS kind FROM part",
)
def json_ragged(spark, t):
    path = scratch_path(spark, "json")
    records = _parts(t).select(F.to_json(F.struct("p_partkey", "p_type")).alias("value"))
    sinks.write_text(records, "value", path)
    items = files.read_json(spark, path, ragged=True, multi_line=False)
    return items.select(
        F.try_variant_get("item", "$.p_partkey", "bigint").alias("id"),
        F.try_variant_get("item", "$.p_type", "string").alias("kind"),
    )


@query(
    "json_roundtrip",
    "SELECT p_partkey, p_name, p_brand, CASE WHEN p_size > 25 THEN p_type END AS p_type FROM part",
)
def json_roundtrip(spark, t):
    path = scratch_path(spark, "json")
    rows = _parts(t)
    sinks.write_json(rows, path)
    return files.read_json(spark, path, schema=rows.schema, multi_line=False)


XML_SCHEMA = "`@id` string, name string, place struct<nation:string,`@kind`:string>"


def _write_xml(spark, t):
    path = scratch_path(spark, "xml")
    rows = t.customer.select(
        F.col("c_custkey").alias("@id"),
        F.col("c_name").alias("name"),
        F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("@kind")).alias("place"),
        F.col("c_acctbal").cast("decimal(12,2)").alias("balance"),
    )
    sinks.write_xml(rows, path, root_element="people", row_element="person")
    return path


XML_ORACLE = """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation,
                       c_mktsegment AS kind FROM customer"""


def _xml_columns(df):
    return df.select(
        F.col("`@id`").alias("id"), "name", F.col("place.nation").alias("nation"), F.col("place.`@kind`").alias("kind")
    )


@query("xml_scan", XML_ORACLE)
def xml_scan(spark, t):
    """Schema found from the files, all values text."""
    return _xml_columns(files.read_xml(spark, _write_xml(spark, t), "person"))


@query("xml_roundtrip", XML_ORACLE)
def xml_roundtrip(spark, t):
    return _xml_columns(files.read_xml(spark, _write_xml(spark, t), "person", schema=XML_SCHEMA))


@query(
    "xml_xsd",
    """SELECT c_acctbal < 0 AS bad, count(*) AS n, count(CASE WHEN c_acctbal >= 0 THEN c_name END) AS named
       FROM customer GROUP BY 1""",
)
def xml_xsd(spark, t):
    """The XSD wants a balance that is not negative."""
    xsd = os.path.join(os.path.dirname(__file__), "person.xsd")
    schema = T.StructType([T.StructField("@id", T.StringType()), T.StructField("name", T.StringType())])
    rows = files.read_xml_checked(spark, _write_xml(spark, t), "person", xsd, schema)
    return rows.groupBy(F.col("_corrupt_record").isNotNull().alias("bad")).agg(
        F.count(F.lit(1)).alias("n"), F.count("name").alias("named")
    )


def _write_documents(spark, t, per_file: int = 5000):
    """Text files of at most ``per_file`` documents."""
    path = scratch_path(spark, "text")
    t.documents.select("text").write.option("maxRecordsPerFile", per_file).text(path)
    return path


@query("text_whole", "SELECT CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents")
def text_whole(spark, t):
    whole = files.read_whole_text(spark, _write_documents(spark, t))
    return whole.agg(F.sum(F.length("content")).alias("chars"))


@query(
    "text_lines",
    """SELECT line AS value, count(*) AS n FROM
       (SELECT unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS line FROM documents) GROUP BY line""",
)
def text_lines(spark, t):
    return files.read_lines(spark, _write_documents(spark, t)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("binary_scan", "SELECT CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents")
def binary_scan(spark, t):
    return files.read_binary(spark, _write_documents(spark, t)).agg(F.sum(F.length("content")).alias("bytes"))


@query(
    "scan_size_guard",
    "SELECT CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes, true AS refused FROM documents",
)
def scan_size_guard(spark, t):
    """All bytes below a limit that every file just keeps, and whether one byte less is refused."""
    path = _write_documents(spark, t)
    largest = files.read_binary(spark, path).agg(F.max("size")).first()[0]
    try:
        files.read_binary(spark, path, max_size=largest - 1)
        refused = False
    except TransformError:
        refused = True
    sizes = files.read_binary(spark, path, max_size=largest).agg(F.sum("size").alias("bytes"))
    return sizes.withColumn("refused", F.lit(refused))


@query("save_modes", "SELECT 2 * count(*) AS rows FROM supplier")
def save_modes(spark, t):
    path = scratch_path(spark, "modes")
    for mode in ("createNew", "overwrite", "append"):
        sinks.write_csv(t.supplier, path, mode=mode)
    return files.read_csv(spark, path, multi_line=False, extra_columns=0).agg(F.count(F.lit(1)).alias("rows"))


@query("compressed_roundtrip", PART_TEXT)
def compressed_roundtrip(spark, t):
    path = scratch_path(spark, "gzip")
    sinks.write_csv(_parts(t), path, compression="gzip")
    return files.read_csv(spark, path, multi_line=False, extra_columns=0)


@query(
    "compressed_sizes",
    """SELECT codec, smaller, (SELECT count(*) FROM orders) AS rows
       FROM (VALUES ('none', false), ('gzip', true), ('deflate', true)) AS c(codec, smaller)""",
)
def compressed_sizes(spark, t):
    """Whether a codec makes the table smaller, and the rows read back."""
    rows = t.orders.select(F.to_json(F.struct("*")).alias("value"))
    reports = []
    for codec in ("none", "gzip", "deflate"):
        path = scratch_path(spark, codec)
        sinks.write_text(rows, "value", path, compression=codec)
        size = sinks.compressed_size(rows, path).select("bytes").scalar()
        back = files.read_lines(spark, path).agg(F.count(F.lit(1)).alias("rows"))
        reports.append(back.select(F.lit(codec).alias("codec"), "rows", size.alias("bytes")))
    together = reports[0].unionByName(reports[1]).unionByName(reports[2])
    plain = reports[0].select("bytes").scalar()
    return together.select("codec", (F.col("bytes") < plain).alias("smaller"), "rows")


@query(
    "archive_members",
    """SELECT 'doc-' || doc_id || '.txt' AS member, octet_length(encode(text)) AS size, md5(text) AS digest, false AS unsafe
       FROM documents
       UNION ALL SELECT '../doc-' || doc_id || '.txt', 0, md5(''), true FROM documents""",
)
def archive_members(spark, t):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                for doc_id, text in zip(batch["doc_id"], batch["text"]):
                    archive.writestr(f"doc-{doc_id}.txt", text)
                    archive.writestr(f"../doc-{doc_id}.txt", text)
            yield pd.DataFrame({"path": [f"part-{batch['doc_id'].iloc[0]}.zip"], "content": [buffer.getvalue()]})

    archives = t.documents.select("doc_id", "text").mapInPandas(pack, "path string, content binary")
    return files.unpack_archives(archives).select("member", "size", F.md5("content").alias("digest"), "unsafe")


@query(
    "object_listing",
    """SELECT o_orderpriority AS priority, count(*) AS rows, true AS filled FROM orders
       WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' GROUP BY 1""",
)
def object_listing(spark, t):
    """The files of two partitions by key prefix, and the rows that those files hold."""
    path = scratch_path(spark, "listing")
    t.orders.write.partitionBy("o_orderpriority").parquet(path)
    listed = files.list_files(spark, path, prefix="o_orderpriority=1").unionByName(
        files.list_files(spark, path, prefix="o_orderpriority=2")
    )
    name = F.element_at(F.split("key", "/"), -1)
    rows = spark.read.parquet(path).groupBy(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("o_orderpriority").alias("priority")
    ).agg(F.count(F.lit(1)).alias("n"))
    folder = F.split("key", "/")[0]
    found = listed.select(name.alias("name"), F.substring(folder, len("o_orderpriority=") + 1, 100).alias("priority"), "size")
    joined = found.join(rows, ["name", "priority"])
    return joined.groupBy("priority").agg(F.sum("n").alias("rows"), F.min(F.col("size") > 0).alias("filled"))


@query(
    "sql_query_params",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 40 AND l_returnflag = 'R'""",
)
def sql_query_params(spark, t):
    return run_sql(
        spark,
        "SELECT l_orderkey, l_linenumber, l_partkey FROM {lines} WHERE l_quantity >= :least AND l_returnflag = :flag",
        tables={"lines": t.lineitem},
        params={"least": 40, "flag": "R"},
    )


@query(
    "bulk_load",
    """SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS VARCHAR) AS phone, CAST(s_acctbal AS DOUBLE) AS balance
       FROM supplier""",
)
def bulk_load(spark, t):
    path = scratch_path(spark, "load")
    target = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("name", T.StringType()),
            T.StructField("phone", T.StringType()),
            T.StructField("balance", T.DoubleType()),
        ]
    )
    source = t.supplier.withColumn("s_acctbal", F.col("s_acctbal").cast("string"))
    mapping = {"s_suppkey": "id", "s_name": "name", "s_acctbal": "balance"}
    sinks.bulk_load(source, target, path=path, column_mapping=mapping)
    return spark.read.schema(target).parquet(path)


CATALOG_TABLES = ("nation", "orders", "part")


# views of this query in the session's catalog
CATALOG_PREFIX = "weft_catalog_"


@query(
    "catalog_columns",
    """SELECT table_name, column_name, CAST(ordinal_position - 1 AS INTEGER) AS position,
              CASE table_name WHEN 'nation' THEN (SELECT count(*) FROM nation)
                              WHEN 'orders' THEN (SELECT count(*) FROM orders)
                              ELSE (SELECT count(*) FROM part) END AS rows
       FROM (VALUES ('nation', 'n_nationkey', 1), ('nation', 'n_name', 2), ('nation', 'n_regionkey', 3),
                    ('orders', 'o_orderkey', 1), ('orders', 'o_custkey', 2), ('orders', 'o_orderstatus', 3),
                    ('orders', 'o_totalprice', 4), ('orders', 'o_orderdate', 5), ('orders', 'o_orderpriority', 6),
                    ('part', 'p_partkey', 1), ('part', 'p_name', 2), ('part', 'p_brand', 3), ('part', 'p_type', 4),
                    ('part', 'p_size', 5), ('part', 'p_retailprice', 6))
            AS c(table_name, column_name, ordinal_position)""",
)
def catalog_columns(spark, t):
    """Columns and rows of tables that the session's catalog lists."""
    for name in CATALOG_TABLES:
        getattr(t, name).createOrReplaceTempView(f"{CATALOG_PREFIX}{name}")
    listed = catalog.session_tables(spark, f"{CATALOG_PREFIX}*")
    tables = {name.removeprefix(CATALOG_PREFIX): df for name, df in listed.items()}
    columns = catalog.import_catalog(spark, tables).select("table_name", "column_name", "position")
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(n)) for n, df in tables.items()]
    sizes = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return columns.join(sizes, "table_name")


@query(
    "sample_rows",
    """SELECT 'sample-' || o_orderkey AS name, o_orderkey + 1 AS id, o_orderkey + 1.5::DOUBLE AS price,
              o_orderkey % 2 = 0 AS even, DATE '2026-01-01' + CAST(o_orderkey AS INTEGER) AS day FROM orders""",
)
def sample_rows(spark, t):
    """Generated values for as many rows as the table has."""
    schema = T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("id", T.LongType()),
            T.StructField("price", T.DoubleType()),
            T.StructField("even", T.BooleanType()),
            T.StructField("day", T.DateType()),
        ]
    )
    return catalog.sample_columns(t.orders, schema, F.col("o_orderkey"))
