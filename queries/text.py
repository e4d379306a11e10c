"""Delimited and plain text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeprofile.operators import columns as column_ops
from lakeprofile.operators.loading import top_rows
from lakeprofile.plans import reading
from lakeprofile.plans.preview import json_safe, preview as preview_file
from lakeprofile.session import scratch_path, write_and_read
from lakeprofile.sources import delimited, dialects
from lakeprofile.sources.chunks import line_counts, record_counts
from lakeprofile.sources.heads import file_heads, type_by_content
from lakeprofile.sources.inventory import inventory
from lakeprofile.sources.splitting import split_delimited
from queries.fixtures import csv_of, documents_csv, documents_text, events_ndjson, once, single_file, table
from queries.writers import write_files

ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string"
)
LINEITEM_TEXT = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """Data files of a Spark-written folder, with the defaults the readers need."""
    return inventory(spark, path).filter("name LIKE 'part-%' AND size > 0").select(
        "path", "name", "size", F.lit("utf-8").alias("encoding"), F.lit(",").alias("delimiter"),
        F.lit(True).alias("has_header"),
    )


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed as the profile says, but for a column of times, which the profile takes for text."""
    rows = reading.read_location(spark, csv_of(spark, sf_dir, "orders"), {"o_orderdate": "timestamp_ntz"})
    return rows.drop(reading.FILE_PATH)


def csv_headerless(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = delimited.read_delimited(spark, csv_of(spark, sf_dir, "customer", header=False), has_header=False)
    return rows.select(F.col("column_1").cast("bigint").alias("column_1"), "column_2", "column_3", "column_4", "column_5")


def csv_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimiter and header of every file of four dialects, with the rows found under them."""
    folders = {
        "comma": csv_of(spark, sf_dir, "orders"),
        "semicolon": csv_of(spark, sf_dir, "customer", sep=";"),
        "pipe": csv_of(spark, sf_dir, "supplier", sep="|"),
        "tab": csv_of(spark, sf_dir, "part", sep="\t"),
    }
    parts = [data_files(spark, path).withColumn("kind", F.lit(kind)) for kind, path in folders.items()]
    files = parts[0]
    for part in parts[1:]:
        files = files.unionByName(part)
    files = files.drop("delimiter", "has_header")
    told = write_and_read(
        delimited.csv_samples(dialects.with_dialects(files)).select("path", "delimiter", "has_header").join(files, "path"), "dialects"
    )
    counts = record_counts(told).select("path", "records")
    rows = F.col("records") - F.when(F.col("has_header"), 1).otherwise(0)
    return told.join(counts, "path").groupBy("kind", "delimiter", "has_header").agg(F.sum(rows).alias("rows"))


def misleading_heads(spark: SparkSession, sf_dir: str) -> str:
    """Orders as delimited files whose first 4,096 characters speak for another delimiter: a long preamble of lists, and a first
    record with one giant quoted field."""

    def rendered(frame, sep: str) -> str:
        return "".join(sep.join(map(str, row)) + "\n" for row in frame.itertuples(index=False))

    def preamble(frame) -> bytes:
        return (("a, b, c, d, " * 20 + "\n") * 40 + rendered(frame, ";")).encode()

    def giant(frame) -> bytes:
        return ('key|note|price\n1|"' + "x;y\n" * 3000 + '"|2.5\n' + rendered(frame.iloc[:, [0, 1, 3]], "|")).encode()

    def write(path: str) -> None:
        orders = table(spark, sf_dir, "orders").drop("o_orderdate")
        write_files(orders, f"{path}/preamble", ".csv", preamble)
        write_files(orders, f"{path}/giant", ".csv", giant)

    return once(spark, sf_dir, "misleading-heads", write)


def whole_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimiters of files whose heads mislead, and how many of the orders' records agree on them."""
    files = data_files(spark, misleading_heads(spark, sf_dir))
    counts = dialects.field_counts(files, 1 << 20).join(dialects.whole_dialects(files, 1 << 20), "path").filter("delimiter = told")
    best = counts.groupBy("path", "told").agg(F.max(F.struct("records", "fields")).alias("best"))
    folder = F.regexp_extract("path", "/([^/]*)/[^/]*$", 1)
    # The header and the long record of each file aren't orders.
    more = F.when(folder == "giant", 2).otherwise(0)
    return best.groupBy(folder.alias("folder"), F.col("told").alias("delimiter"), F.col("best.fields").alias("fields")).agg(
        F.sum(F.col("best.records") - more).alias("records"))


def csv_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the line items, header excluded."""
    counts = record_counts(data_files(spark, csv_of(spark, sf_dir, "lineitem")))
    return counts.agg(F.sum(F.col("records") - 1).alias("row_count"))


def csv_quoted_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per language of whole documents, whose fields hold line breaks and quotes."""
    counts = record_counts(data_files(spark, documents_csv(spark, sf_dir)), chunk_bytes=1 << 20)
    return counts.groupBy(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang")).agg(
        F.sum(F.col("records") - 1).alias("row_count"), F.bool_or("quoted_breaks").alias("quoted_breaks")
    )


def csv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited files with line breaks and quotes inside fields, cut into parts of whole records and read back."""
    files = data_files(spark, documents_csv(spark, sf_dir))
    folder = scratch_path(spark, "csv-parts")
    parts = split_delimited(files, folder, part_bytes=1 << 17)
    sizes = parts.groupBy("path").agg(F.sum("bytes").alias("written"), F.count("*").alias("parts"))
    whole = files.join(sizes, "path", "left").agg(
        F.bool_and(F.coalesce(F.col("written") == F.col("size"), F.lit(False))).alias("every_byte"), (F.sum("parts") > F.count("*")).alias("several")).first()
    rows = delimited.read_delimited(spark, folder, "doc_id bigint, text string, source string", multiLine=True)
    return rows.withColumns({"every_byte": F.lit(whole.every_byte), "several": F.lit(whole.several)})


def row_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated against exact rows: every estimate is within a tenth."""
    files = data_files(spark, csv_of(spark, sf_dir, "lineitem"))
    estimated = delimited.row_estimate(files, lines=500).join(record_counts(files), "path")
    exact = F.sum(F.col("records") - 1)
    return estimated.agg(exact.alias("exact"),
                         (F.abs(F.sum("row_estimate") - exact) <= exact / 10).alias("within_tenth"))


def string_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_ops.string_widths(delimited.read_delimited(spark, csv_of(spark, sf_dir, "lineitem")))


def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    inferred = column_ops.infer_types(delimited.read_delimited(spark, csv_of(spark, sf_dir, "lineitem")))
    return inferred.select(F.col("ordinal").cast("bigint").alias("ordinal"), "name", "detected_type", "null_count")


def gapped_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
        F.expr("CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END").alias("c_nationkey"),
        F.expr("CASE WHEN c_custkey % 2 = 0 THEN true WHEN c_custkey % 5 = 0 THEN false END").alias("c_flag"),
    )


def infer_gapped_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types where columns have gaps: missing integers widen, missing booleans fall back to text."""
    path = once(spark, sf_dir, "gapped-customers", lambda where: gapped_customers(spark, sf_dir).write.csv(
        where, header=True))
    inferred = column_ops.infer_types(delimited.read_delimited(spark, path))
    return inferred.select("name", "detected_type", "null_count")


def null_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_ops.null_distribution(gapped_customers(spark, sf_dir)).select("name", "nulls")


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three orders per status."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return column_ops.first_rows(orders, "o_orderstatus", "o_orderkey", 3)


def dup_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated names in raw header lines, which a reader would silently rename."""

    def render(frame) -> bytes:
        return ("id,Name,ID,name,value\n" + "\n".join(frame["line"])).encode()

    def write(path: str) -> None:
        line = F.concat_ws(",", "c_custkey", "c_name", "c_custkey", "c_name", "c_acctbal")
        write_files(table(spark, sf_dir, "customer").select(line.alias("line")), path, ".csv", render)

    files = data_files(spark, once(spark, sf_dir, "duplicate-headers", write))
    headers = delimited.csv_samples(files).select("path", F.col("raw_names").alias("names"))
    counted = column_ops.duplicate_names(headers).join(record_counts(files).select("path", "records"), "path")
    return counted.groupBy("name").agg(F.sum(F.col("records") - 1).alias("rows"))


def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents, white space at their ends removed."""
    lines = spark.read.text(documents_text(spark, sf_dir)).select("lang", F.regexp_replace("value", r"\s+$", "").alias("line"))
    return lines.groupBy("lang").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def text_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per language, counted in byte ranges of every file."""
    counts = line_counts(data_files(spark, documents_text(spark, sf_dir)), chunk_bytes=1 << 20)
    return counts.groupBy(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang")).agg(
        F.sum("row_count").alias("lines")
    )


def clob_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files as one text each."""

    def write(path: str) -> None:
        table(spark, sf_dir, "documents").select("text").write.option("maxRecordsPerFile", 200).text(path)

    path = once(spark, sf_dir, "document-files", write)
    files = spark.read.text(path, wholetext=True)
    breaks = F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit("")))
    return files.agg(F.sum(F.length("value")).alias("chars"), F.sum(breaks).cast("bigint").alias("line_breaks"))


def sniff_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of files from their first bytes alone."""
    folders = {
        "lines of objects": events_ndjson(spark, sf_dir),
        "delimited": csv_of(spark, sf_dir, "orders"),
        "prose": documents_text(spark, sf_dir),
        "columnar": once(spark, sf_dir, "orders-parquet", lambda p: table(spark, sf_dir, "orders").write.parquet(p)),
    }
    parts = [data_files(spark, path).withColumn("kind", F.lit(kind)) for kind, path in folders.items()]
    files = parts[0]
    for part in parts[1:]:
        files = files.unionByName(part)
    heads = file_heads(files.withColumn("file_type", F.lit(None).cast("string")))
    typed = heads.withColumn("file_type", type_by_content(F.col("head"), F.col("looks_delimited")))
    return files.join(typed, "path").select("kind", "file_type").distinct()


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First hundred customers of one delimited file."""
    return preview_file(spark, single_file(spark, sf_dir, "customer"), 100).select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_mktsegment"
    )


def preview_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as preview values: numbers kept, times as text."""
    safe = json_safe(table(spark, sf_dir, "events").select("event_id", "ts", "value"))
    return safe.select("event_id", F.substring("ts", 1, 19).alias("ts"), "value")


def openrowset_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = delimited.read_delimited(spark, csv_of(spark, sf_dir, "orders"), ORDERS, **LINEITEM_TEXT)
    return top_rows(rows.select("o_orderkey", "o_custkey", "o_orderstatus"), 100, "o_orderkey")


def openrowset_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited files under an explicit column list."""
    return delimited.read_delimited(
        spark, csv_of(spark, sf_dir, "customer"),
        "c_custkey bigint, c_name string, c_nationkey bigint, c_acctbal decimal(12,2), c_mktsegment string",
    ).select("c_custkey", "c_name", "c_nationkey", (F.col("c_acctbal") * 100).cast("bigint").alias("cents"))


QUERIES = {
    "csv_scan": csv_scan,
    "csv_headerless": csv_headerless,
    "csv_dialect": csv_dialect,
    "whole_dialect": whole_dialect,
    "csv_row_count": csv_row_count,
    "csv_quoted_row_count": csv_quoted_row_count,
    "csv_split": csv_split,
    "row_estimate": row_estimate,
    "string_widths": string_widths,
    "infer_types": infer_types,
    "infer_gapped_types": infer_gapped_types,
    "null_distribution": null_distribution,
    "sample_rows": sample_rows,
    "dup_columns": dup_columns,
    "text_scan": text_scan,
    "text_line_count": text_line_count,
    "clob_read": clob_read,
    "sniff_content": sniff_content,
    "preview": preview,
    "preview_values": preview_values,
    "openrowset_top": openrowset_top,
    "openrowset_schema": openrowset_schema,
}

_LINES = "(length(text) - length(replace(text, chr(10), '')) + 1)"
_TYPES = [("l_orderkey", "int64"), ("l_partkey", "int64"), ("l_suppkey", "int64"), ("l_linenumber", "int64"),
          ("l_quantity", "float64"), ("l_extendedprice", "float64"), ("l_discount", "float64"), ("l_tax", "float64"),
          ("l_returnflag", "object"), ("l_linestatus", "object"), ("l_shipdate", "object")]

ORACLES = {
    "csv_scan": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
    "csv_headerless": """
        SELECT c_custkey AS column_1, c_name AS column_2, c_nationkey::VARCHAR AS column_3, c_acctbal::VARCHAR AS column_4,
               c_mktsegment AS column_5 FROM customer""",
    "csv_dialect": """
        SELECT 'comma' AS kind, ',' AS delimiter, true AS has_header, count(*) AS rows FROM orders
        UNION ALL SELECT 'semicolon', ';', true, count(*) FROM customer
        UNION ALL SELECT 'pipe', '|', true, count(*) FROM supplier
        UNION ALL SELECT 'tab', chr(9), true, count(*) FROM part""",
    "whole_dialect": """
        SELECT 'preamble' AS folder, ';' AS delimiter, 5::BIGINT AS fields, count(*) AS records FROM orders
        UNION ALL SELECT 'giant', '|', 3, count(*) FROM orders""",
    "csv_row_count": "SELECT count(*) AS row_count FROM lineitem",
    "csv_quoted_row_count": """
        SELECT lang, count(*) AS row_count, max(contains(text, chr(10))) AS quoted_breaks FROM documents GROUP BY lang""",
    "csv_split": "SELECT doc_id, text, source, true AS every_byte, true AS several FROM documents",
    "row_estimate": "SELECT count(*) AS exact, true AS within_tenth FROM lineitem",
    "string_widths": """
        SELECT name, w AS observed_max_len, CAST(ceil(w * 1.25) AS BIGINT) AS sized_len, 'NVARCHAR(255)' AS sql_type
        FROM (UNPIVOT (SELECT max(length(l_orderkey::VARCHAR)) AS l_orderkey, max(length(l_partkey::VARCHAR)) AS l_partkey,
                  max(length(l_suppkey::VARCHAR)) AS l_suppkey, max(length(l_linenumber::VARCHAR)) AS l_linenumber,
                  max(length(l_quantity::VARCHAR)) AS l_quantity, max(length(l_extendedprice::VARCHAR)) AS l_extendedprice,
                  max(length(l_discount::VARCHAR)) AS l_discount, max(length(l_tax::VARCHAR)) AS l_tax,
                  max(length(l_returnflag)) AS l_returnflag, max(length(l_linestatus)) AS l_linestatus,
                  max(length(l_shipdate::VARCHAR)) AS l_shipdate FROM lineitem) ON COLUMNS(*) INTO NAME name VALUE w)""",
    "infer_types": "SELECT * FROM (VALUES " + ", ".join(
        f"({at + 1}::BIGINT, '{name}', '{kind}', 0::BIGINT)" for at, (name, kind) in enumerate(_TYPES)
    ) + ") t(ordinal, name, detected_type, null_count)",
    "infer_gapped_types": """
        SELECT 'c_custkey' AS name, 'int64' AS detected_type, 0::BIGINT AS null_count
        UNION ALL SELECT 'c_mktsegment', 'object', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'
        UNION ALL SELECT 'c_nationkey', 'float64', count(*) FROM customer WHERE c_custkey % 3 = 0
        UNION ALL SELECT 'c_flag', 'object', count(*) FROM customer WHERE c_custkey % 2 <> 0 AND c_custkey % 5 <> 0""",
    "null_distribution": """
        SELECT 'c_custkey' AS name, 0::BIGINT AS nulls
        UNION ALL SELECT 'c_mktsegment', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'
        UNION ALL SELECT 'c_nationkey', count(*) FROM customer WHERE c_custkey % 3 = 0
        UNION ALL SELECT 'c_flag', count(*) FROM customer WHERE c_custkey % 2 <> 0 AND c_custkey % 5 <> 0""",
    "sample_rows": """
        SELECT o_orderkey, o_orderstatus, o_custkey FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 3""",
    "dup_columns": "SELECT unnest(['id', 'name']) AS name, count(*) AS rows FROM customer",
    "text_scan": f"""
        SELECT lang, sum({_LINES})::BIGINT AS lines, sum(chars)::BIGINT AS chars
        FROM (SELECT lang, text,
                     list_sum(list_transform(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '\\s+$', '')))) AS chars
              FROM documents)
        GROUP BY lang""",
    "text_line_count": f"SELECT lang, sum({_LINES})::BIGINT AS lines FROM documents GROUP BY lang",
    "clob_read": f"""
        SELECT sum(length(text) + 1)::BIGINT AS chars, sum({_LINES})::BIGINT AS line_breaks FROM documents""",
    "sniff_content": """
        SELECT 'lines of objects' AS kind, 'json' AS file_type UNION ALL SELECT 'delimited', 'csv'
        UNION ALL SELECT 'columnar', 'parquet' UNION ALL SELECT 'prose', 'text'""",
    "preview": "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 100",
    "preview_values": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value FROM events",
    "openrowset_top": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100",
    "openrowset_schema": """
        SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey,
               (c_acctbal::DECIMAL(12,2) * 100)::BIGINT AS cents FROM customer""",
}
