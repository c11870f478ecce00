"""Scans and sinks on small files."""

import gzip
import io
import os
import tarfile
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftframe.expressions import TransformError
from weftframe.session import scratch_path
from weftframe.sources import catalog, files, sinks


def put(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_header_and_types(spark, tmp_path):
    path = put(tmp_path, "p.csv", "name,dept,age\nAda,eng,36\n\nKay,sales,28\nBad,,x\n,,\n")
    df = files.read_csv(spark, path)
    assert [d for _, d in df.dtypes] == ["string"] * 3
    assert df.count() == 3
    assert df.where("dept is null").first()["name"] == "Bad"


def test_csv_headerless_delimiter_and_quotes(spark, tmp_path):
    df = files.read_csv(spark, put(tmp_path, "a.csv", "Ada,36\nGrace,45\n"), has_header=False)
    assert df.columns == ["column0", "column1"]
    semi = files.read_csv(spark, put(tmp_path, "b.csv", "a;b\n1;2\n"), delimiter=";")
    assert semi.first().asDict() == {"a": "1", "b": "2"}
    quoted = files.read_csv(spark, put(tmp_path, "c.csv", 'name,note\nAda,"x, ""y""\nz"\n'))
    assert quoted.first()["note"] == 'x, "y"\nz'


def test_csv_long_and_short_rows(spark, tmp_path):
    wide = ",".join(str(i) for i in range(30))
    path = put(tmp_path, "r.csv", f"a,b\n1\n1,2,3\n{wide}\n")
    df = files.read_csv(spark, path)
    assert len(df.columns) == 30
    assert df.columns[:4] == ["a", "b", "column2", "column3"]
    assert df.where("a = '0'").first()["column29"] == "29"
    assert df.where("b is null").count() == 1


@pytest.mark.parametrize("encoding, python", [("latin1", "latin-1"), ("utf-16", "utf-16-le"), (None, "utf-8")])
def test_encodings(spark, tmp_path, encoding, python):
    path = put(tmp_path, "e.csv", "name\nÉva\n", python)
    assert files.read_csv(spark, path, encoding=encoding).first()["name"] == "Éva"


@pytest.mark.parametrize("encoding, python", [("latin1", "latin-1"), ("utf-16", "utf-16-le"), ("utf-16be", "utf-16-be")])
def test_lines_and_whole_text_in_other_encodings(spark, tmp_path, encoding, python):
    path = put(tmp_path, "e.txt", "É\r\n\nü", python)
    assert [r["value"] for r in files.read_lines(spark, path, encoding).collect()] == ["É", "", "ü"]
    assert files.read_whole_text(spark, path, encoding=encoding).first()["content"] == "É\r\n\nü"


def test_compression_levels(spark):
    df = spark.range(20_000).selectExpr("concat('row ', id, ' ', id % 97) as value").coalesce(1)
    sizes = {}
    for level in ("noCompression", "fastest", "optimal", "smallestSize"):
        path = scratch_path(spark, "t")
        sinks.write_text(df, "value", path, compression="gzip", level=level)
        assert spark.read.text(path).count() == 20_000
        sizes[level] = sinks.compressed_size(df, path).first()["bytes"]
    assert sizes["noCompression"] > sizes["fastest"] > max(sizes["optimal"], sizes["smallestSize"])
    with pytest.raises(TransformError):
        sinks.write_text(df, "value", scratch_path(spark, "t"), level="huge")


def test_json_roots_and_ragged(spark, tmp_path):
    array = files.read_json(spark, put(tmp_path, "a.json", '[{"a":1},{"a":2,"b":"x"}]'))
    assert array.count() == 2
    single = files.read_json(spark, put(tmp_path, "o.json", '{\n "a": {"b": [1, 2]}\n}'))
    assert single.select("a.b").first()[0] == [1, 2]
    ragged = files.read_json(spark, put(tmp_path, "r.json", '[{"a":1},{"a":"x"}]'), ragged=True)
    assert sorted(r[0] for r in ragged.select(F.try_variant_get("item", "$.a", "string")).collect()) == ["1", "x"]


def test_json_sink_writes_nulls(spark):
    path = scratch_path(spark, "t")
    sinks.write_json(spark.sql("select 1 as a, cast(null as string) as b"), path)
    assert spark.read.text(path).first()[0] == '{"a":1,"b":null}'


def test_xml_attributes_and_lists(spark, tmp_path):
    text = '<root><person id="7"><name>Ada</name><tag>a</tag><tag>b</tag></person></root>'
    path = put(tmp_path, "p.xml", text)
    assert [r["value"] for r in files.read_xml_nodes(spark, path, "//tag").collect()] == ["a", "b"]
    row = files.read_xml(spark, path, "person").first()
    assert (row["@id"], row["name"], row["tag"]) == ("7", "Ada", ["a", "b"])


def test_whole_text_binary_and_size_guard(spark, tmp_path):
    put(tmp_path, "a.txt", "one\ntwo")
    put(tmp_path, "b.txt", "x" * 100)
    folder = str(tmp_path)
    whole = files.read_whole_text(spark, folder)
    assert {r["content"] for r in whole.collect()} == {"one\ntwo", "x" * 100}
    assert files.read_lines(spark, folder).count() == 3
    assert files.read_binary(spark, folder, max_size=100).count() == 2
    with pytest.raises(TransformError, match="b.txt has 100 bytes, more than 50"):
        files.read_binary(spark, folder, max_size=50)
    listed = files.list_files(spark, folder, pattern="*.txt", prefix="b")
    assert [r["size"] for r in listed.collect()] == [100]
    first = files.list_files(spark, folder, max_keys=1).collect()
    assert [(r["key"], r["truncated"]) for r in first] == [("a.txt", True)]


def test_listing_has_every_file_and_takes_prefixes_of_whole_keys(spark, tmp_path):
    for i in range(1200):
        put(tmp_path, f"n{i:04}.txt", "x")
    (tmp_path / "logs" / "a").mkdir(parents=True)
    put(tmp_path / "logs" / "a", "one.txt", "x")
    folder = str(tmp_path)
    assert files.list_files(spark, folder).count() == 1201
    assert [r["key"] for r in files.list_files(spark, f"file://{folder}/", prefix="logs/").collect()] == ["logs/a/one.txt"]


def test_single_gzip_files_and_bounded_members(spark, tmp_path):
    (tmp_path / "a.txt.gz").write_bytes(gzip.compress(b"hello" * 100))
    got = files.read_archives(spark, str(tmp_path)).first()
    assert (got["member"], got["size"]) == ("a.txt", 500)
    with pytest.raises(PySparkException, match="more than 100 bytes"):
        files.read_archives(spark, str(tmp_path), max_member=100).collect()
    assert files.read_archives(spark, str(tmp_path), kind="gzip").count() == 1


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("dir/x.txt", "hello")
        z.writestr("../evil.txt", "boo")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("y.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    rows = {r["member"]: (r["size"], r["unsafe"]) for r in files.read_archives(spark, str(tmp_path)).collect()}
    assert rows == {"dir/x.txt": (5, False), "../evil.txt": (0, True), "y.txt": (3, False)}
    assert files.escapes_root("a/../../b") and files.escapes_root("/etc/x") and not files.escapes_root("a/../b")
    with pytest.raises(TransformError):
        files.archive_format("x.rar")


def test_save_modes(spark):
    path = scratch_path(spark, "t")
    df = spark.range(3).selectExpr("cast(id as string) as id")
    sinks.write_text(df, "id", path, mode="createNew")
    with pytest.raises(PySparkException):
        sinks.write_text(df, "id", path, mode="createNew")
    sinks.write_text(df, "id", path, mode="append")
    assert spark.read.text(path).count() == 6
    with pytest.raises(TransformError):
        sinks.save_mode("sometimes")


def test_bulk_load(spark):
    target = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("price", T.DecimalType(12, 4))])
    path = scratch_path(spark, "t")
    df = spark.range(100).selectExpr("id as key", "'1.50' as price")
    assert sinks.bulk_load(df, target, path=path, column_mapping={"key": "id"}) == 100
    assert sinks.bulk_load(df.where("false"), target, path=path) == 0
    assert spark.read.parquet(path).where("id is null").count() == 0
    missing = sinks.load_frame(df, target).first()
    assert missing["id"] is None and str(missing["price"]) == "1.5000"
    with pytest.raises(PySparkException, match="column 'id': bad value"):
        sinks.load_frame(spark.sql("select 'x' as id"), target).collect()


def test_types_and_samples(spark):
    assert catalog.spark_type("numeric(12,4)") == T.DecimalType(12, 4)
    assert catalog.spark_type("VARCHAR(255)") == T.StringType()
    with pytest.warns(UserWarning):
        assert catalog.spark_type("geometry") == T.StringType()
    with pytest.raises(TransformError):
        catalog.spark_type("geometry", strict=True)
    schema = T.StructType(
        [
            T.StructField("s", T.StringType()),
            T.StructField("i", T.IntegerType()),
            T.StructField("d", T.DoubleType()),
            T.StructField("b", T.BooleanType()),
            T.StructField("t", T.TimestampNTZType()),
            T.StructField("x", T.BinaryType()),
            T.StructField("p", T.DayTimeIntervalType()),
            T.StructField("a", T.ArrayType(T.IntegerType())),
        ]
    )
    row = catalog.sample_rows(spark, schema, 2).orderBy("i").collect()[1]
    assert (row["s"], row["i"], row["d"], row["b"], str(row["t"])) == ("sample-1", 2, 2.5, False, "2026-01-02 00:00:00")
    assert (bytes(row["x"]), row["p"].total_seconds(), row["a"]) == (b"\x02", 7200, None)


def test_catalog_import(spark):
    spark.range(1).createOrReplaceTempView("catalog_probe")
    tables = {n: df for n, df in catalog.session_tables(spark).items() if n == "catalog_probe"}
    row = catalog.import_catalog(spark, tables).first()
    assert tuple(row) == ("catalog_probe", "id", 0, "bigint", False)


def test_scratch_folder_follows_the_session(spark):
    assert scratch_path(spark, "x").startswith(os.path.join(spark.conf.get("spark.checkpoint.dir"), "weftframe-x-"))


def test_xml_files_are_bounded(spark, tmp_path):
    path = str(tmp_path / "people")
    rows = spark.range(60_000).select(F.col("id").alias("@id")).coalesce(1)
    sinks.write_xml(rows, path, root_element="people", row_element="person")
    assert len([f for f in os.listdir(path) if f.endswith(".xml")]) == 2
    sinks.write_xml(rows.limit(10), path, root_element="people", row_element="person", rows_per_file=4)
    assert len([f for f in os.listdir(path) if f.endswith(".xml")]) == 3
    back = files.read_xml(spark, path, "person", schema="`@id` string")
    assert sorted(int(r[0]) for r in back.collect()) == list(range(10))
