"""Column expressions on single values."""

import math

import pytest
from pyspark.sql import functions as F

from lakeprofile.functions import encodings, jsonfn, names, paths, sqltypes, urls


def value(spark, text, expression):
    return spark.createDataFrame([(text,)], "x string").select(expression(F.col("x")).alias("v")).first().v


@pytest.mark.parametrize("given, clean", [
    ("123invalid", "col_123invalid"), ("name-with-dashes", "name_with_dashes"), ("", "column_1"), ("é", "_"),
])
def test_identifiers(spark, given, clean):
    assert value(spark, given, names.clean_identifier) == clean


@pytest.mark.parametrize("path, table", [
    ("/in/2024 sales.csv", "ext_tbl_2024_sales"), ("s3://b/a%3Fb.csv", "ext_a_b"), ("/in/größe.csv", "ext_größe"),
    ("/in/.profile", "ext__profile"), ("/in/", "ext_external_table"), ("/in/a.b.csv", "ext_a_b"),
])
def test_table_names(spark, path, table):
    assert value(spark, path, names.table_name) == table


@pytest.mark.parametrize("kind, sql", [
    ("int64", "BIGINT"), ("int32", "INT"), ("float64", "FLOAT"), ("bool", "BIT"), ("object", "NVARCHAR(255)"),
    ("nothing known", "NVARCHAR(255)"), ("decimal128(12, 2)", "DECIMAL(38,10)"), ("numeric(5)", "DECIMAL(18,4)"),
])
def test_types(spark, kind, sql):
    assert value(spark, kind, sqltypes.sql_type) == sql


@pytest.mark.parametrize("length, sql", [(50, "NVARCHAR(255)"), (200, "NVARCHAR(255)"), (201, "NVARCHAR(250)"),
                                         (300, "NVARCHAR(350)"), (3999, "NVARCHAR(4000)"), (5000, "NVARCHAR(MAX)")])
def test_string_types(spark, length, sql):
    assert value(spark, str(length), lambda x: sqltypes.string_type(x.cast("bigint"))) == sql


@pytest.mark.parametrize("given, safe", [
    ("INT", "INT"), ("decimal(18, 4)", "decimal(18, 4)"), ("NVARCHAR(max)", "NVARCHAR(max)"),
    ("INT, [x] AS (1) --", "NVARCHAR(MAX)"), ("", "NVARCHAR(MAX)"),
])
def test_safe_types(spark, given, safe):
    assert value(spark, given, names.safe_sql_type) == safe


@pytest.mark.parametrize("size, text", [(0, "0 B"), (1023, "1023.0 B"), (1280, "1.2 KB"), (1792, "1.8 KB"),
                                        (5 * 1024**2, "5.0 MB"), (3 * 1024**4, "3072.0 GB")])
def test_sizes(spark, size, text):
    assert value(spark, str(size), names.readable_size) == text


def test_one_line(spark):
    assert value(spark, "  a\r\n\tb c \x85", names.one_line) == "a b c"


@pytest.mark.parametrize("url, kind", [
    ("s3://b/k", "s3"), ("azure://c/b", "azure"), ("https://a.blob.core.windows.net/c/b", "azure"),
    ("https://account.blob.core.windows.net.attacker.example/c/b", "local"), ("https://example.com/x", "local"),
    ("https://x@a.blob.core.windows.net:443/c", "azure"), ("/data/x.csv", "local"),
])
def test_storage_kind(spark, url, kind):
    assert value(spark, url, urls.storage_kind) == kind


def test_object_addresses(spark):
    found = value(spark, "https://a.blob.core.windows.net/my%20box/x%2By+z.csv", urls.object_address)
    assert (found.container, found.key, found.error) == ("my box", "x+y+z.csv", None)
    assert value(spark, "s3://bucket", lambda x: urls.object_address(x, True)).error == "missing key"
    assert value(spark, "s3:///key", urls.object_address).error == "missing container"


@pytest.mark.parametrize("name, suffix", [("a.CSV", ".csv"), (".bashrc", ""), ("x.tar.gz", ".gz"), ("plain", "")])
def test_suffixes(spark, name, suffix):
    assert value(spark, name, paths.path_suffix) == suffix


def test_encoding_of_a_cut_prefix(spark):
    data = "naïve – ж 𝄞 ".encode() * 3
    rows = [(bytearray(data[:cut]), cut) for cut in range(4, len(data))]
    found = spark.createDataFrame(rows, "b binary, n int").select(
        "n", encodings.detect_encoding(F.col("b"), F.lit(False)).alias("e")).collect()
    assert {row.e.encoding for row in found} == {"utf-8"}


def test_encoding_of_undecodable_bytes(spark):
    rows = [(bytearray(b"abc \xe9t\xe9"),), (bytearray(b"abc \x81"),), (bytearray(b""),)]
    found = spark.createDataFrame(rows, "b binary").select(encodings.detect_encoding("b").alias("e")).collect()
    assert [row.e.encoding for row in found] == ["cp1252", "latin-1", "ascii"]


def test_json_documents(spark):
    assert value(spark, ' {"a":1}', jsonfn.is_json) is True
    assert value(spark, "42", jsonfn.is_json) is False
    assert value(spark, '{"a":1', jsonfn.is_json) is False
    doc = '{"b":1,"a":{"z":[1]},"n":null}'
    assert value(spark, doc, lambda x: jsonfn.json_value(x, "$.a")) is None
    assert value(spark, doc, lambda x: jsonfn.json_query(x, "$.a")) == '{"z":[1]}'
    assert value(spark, doc, lambda x: jsonfn.json_path_exists(x, "$.n")) is True
    assert value(spark, doc, lambda x: jsonfn.json_path_exists(x, "$.m")) is False
    assert value(spark, doc, lambda x: jsonfn.json_set(x, "n", F.lit("x"))) == '{"b":1,"a":{"z":[1]},"n":"x"}'


def test_json_pieces_make_one_document(spark):
    import json

    rows = spark.createDataFrame([(n, None if n % 2 else f"v{n}") for n in range(20)], "id int, v string")
    pieces = jsonfn.json_rows(rows.repartition(5), "id", root='o"k').orderBy("id").collect()
    document = json.loads("".join(row.fragment for row in pieces))
    assert [item["id"] for item in document['o"k']] == list(range(20))
    assert "v" not in document['o"k'][1]


def test_numbers_without_json_form(spark):
    found = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (1.5,), (None,)], "x double").select(
        jsonfn.finite_or_null("x").alias("v")).collect()
    assert [row.v for row in found] == [None, None, None, 1.5, None]
