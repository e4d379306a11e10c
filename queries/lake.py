"""Inventory and profiles of real folders; operators on listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeprofile.functions.paths import type_by_extension
from lakeprofile.operators import listing as listing_ops
from lakeprofile.plans import preview as preview_plan, profile as profile_plan, reading
from lakeprofile.sources import inventory as inventory_source, parquet, workbook
from lakeprofile.sources.inventory import inventory
from queries.fixtures import LISTING, events_ndjson, listing, once, table
from queries.writers import write_files, write_workbooks

TABLES = [
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation",
    "orders", "pages", "part", "region", "supplier",
]


def table_of(path: str) -> F.Column:
    """Table a data file belongs to, whether the table is one file or a folder of them."""
    return F.regexp_extract(path, "/([a-z]+)\\.parquet(?:/[^/]*)?$", 1)


def data_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir).filter(F.col("name").endswith(".parquet") & (table_of("path") != ""))


def inventory_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data files of the given tables, by table."""
    return data_files(spark, sf_dir).select(
        table_of("path").alias("table"), "extension", "scheme", "is_table_root"
    ).distinct().orderBy("table")


def file_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and time of each file, and errors of paths that do not exist, as rows."""
    files = data_files(spark, sf_dir).select("path")
    missing = files.select(F.concat("path", F.lit(".gone")).alias("path"))
    entries = inventory_source.inventory_of_paths(files.unionByName(missing))
    return entries.groupBy(table_of(F.regexp_replace("path", "\\.gone$", "")).alias("table")).agg(
        F.bool_or(F.col("size") > 0).alias("has_size"), F.bool_or(F.col("modified").isNotNull()).alias("has_time"),
        F.bool_or(F.col("error").isNotNull()).alias("missing_reported"),
    )


def list_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level of a lake of mixed formats."""
    return profile_plan.browse(spark, mixed_lake(spark, sf_dir)).select("name", "kind", "file_type")


def mixed_lake(spark: SparkSession, sf_dir: str) -> str:
    """A lake with folders of several formats, all written from the given tables."""

    def write(path: str) -> None:
        customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
        quoted = {"header": True, "escape": '"'}
        customer.write.options(**quoted).csv(f"{path}/customers")
        orders.write.parquet(f"{path}/orders")
        events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
        events.write.json(f"{path}/events")
        documents = table(spark, sf_dir, "documents")
        documents.select("text").write.text(f"{path}/texts")
        documents.select("doc_id", "text", "lang").write.options(quoteAll=True, **quoted).csv(f"{path}/documents")
        orders.select("o_orderkey", "o_custkey").write.parquet(f"{path}/sales.delta")
        customer.limit(0).write.json(f"{path}/sales.delta/_delta_log")

    return once(spark, sf_dir, "mixed-lake", write)


def customer_lake(spark: SparkSession, sf_dir: str) -> str:
    """Customers dealt to seven folders: two dialects of delimited text in one of them, lines and arrays of JSON, ORC, Parquet,
    text, and a Delta layout. Key types differ, and not every folder has every column."""

    def write(path: str) -> None:
        customer = table(spark, sf_dir, "customer")

        def part(number: int) -> DataFrame:
            return customer.filter(F.col("c_custkey") % 7 == number)

        def rendered(sep: str, codec: str):
            def render(frame) -> bytes:
                lines = [sep.join(frame.columns), *[sep.join(f'"{value}"' if isinstance(value, str) else str(value) for value in row)
                                                    for row in frame.itertuples(index=False)]]
                return ("\n".join(lines) + "\n").encode(codec)
            return render

        write_files(part(0), f"{path}/dialects/a", ".csv", rendered(",", "utf-8"))
        marked = part(1).withColumn("c_name", F.concat("c_name", F.lit("€")))
        write_files(marked, f"{path}/dialects/b", ".csv", rendered(";", "cp1252"))
        part(2).write.json(f"{path}/lines")
        # Spark's own text files would not end in .json.
        write_files(part(3).drop("c_mktsegment"), f"{path}/arrays", ".json", lambda frame: frame.to_json(orient="records").encode())
        part(4).withColumn("c_nationkey", F.col("c_nationkey").cast("short")).write.orc(f"{path}/columns/orc")
        part(5).withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(12,2)")).write.parquet(f"{path}/columns/parquet")
        part(6).select("c_name").write.text(f"{path}/names")

    return once(spark, sf_dir, "customer-lake", write)


def lake_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call reads every format and dialect of a lake as one typed table."""
    root = customer_lake(spark, sf_dir)
    rows = reading.read_location(spark, root)
    return rows.select(
        F.regexp_extract(F.substr(reading.FILE_PATH, F.lit(len(root) + 2)), "^(.*)/[^/]*$", 1).alias("folder"),
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "line")


def late_bytes(spark: SparkSession, sf_dir: str) -> str:
    """Documents as text files of four encodings, each of which begins with 70,000 ASCII characters."""

    def renderer(codec: str, more: str):
        def render(frame) -> bytes:
            return ("x" * 70_000 + "\n".join(frame["text"]) + more + "\n").encode(codec, "replace")
        return render

    def write(path: str) -> None:
        texts = table(spark, sf_dir, "documents").select("text")
        # The last characters tell two single-byte encodings apart: one of them leaves 0x81 undefined.
        for folder, codec, more in (("ascii", "ascii", ""), ("utf-8", "utf-8", "é"), ("cp1252", "cp1252", "é€"), ("latin-1", "latin-1", "é\x81")):
            write_files(texts, f"{path}/{folder}", ".txt", renderer(codec, more))

    return once(spark, sf_dir, "late-bytes", write)


def whole_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodings of files whose first byte beyond ASCII comes late, the note on unsure ones, and their lines."""
    profiles = profile_plan.profile_folder(spark, late_bytes(spark, sf_dir), chunk_bytes=1 << 20)
    return profiles.groupBy(F.regexp_extract("path", "/([^/]*)/[^/]*$", 1).alias("folder"), "encoding", "encoding_confidence", "encoding_warning").agg(
        F.sum("row_count").alias("lines"))


def location_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, rows and failures per type at the given location, tables being one file or many."""
    profiles = profile_plan.profile_location(spark, sf_dir)
    data = profiles.filter((table_of("path") != "") & F.col("name").endswith(".parquet"))
    tables = F.count_distinct(table_of("path")).alias("tables")
    return profile_plan.location_summary(data, tables).select(
        "file_type", "tables", "total_rows", "failed", (F.col("total_size") > 0).alias("has_bytes")
    )


def parquet_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns per table from footers alone."""
    footers = parquet.footers(data_files(spark, sf_dir))
    return footers.groupBy(table_of("path").alias("table")).agg(
        F.sum("row_count").alias("rows"), F.max("column_count").alias("columns")
    )


def profile_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of a lake of mixed formats: rows per folder and type."""
    root = mixed_lake(spark, sf_dir)
    profiles = profile_plan.profile_location(spark, root)
    folder = F.regexp_extract(F.substr("path", F.lit(len(root) + 2)), "^([^/]*)", 1)
    data = profiles.filter("(name LIKE 'part-%' AND size > 0) OR file_type = 'delta'")
    return data.groupBy(folder.alias("folder"), "file_type").agg(
        F.sum("row_count").alias("rows"), F.max("column_count").alias("columns"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column profiles of the delimited and line-delimited folders of the lake."""
    profiles = profile_plan.profile_folder(spark, mixed_lake(spark, sf_dir)).filter("name LIKE 'part-%'")
    columns = profile_plan.column_profiles(profiles)
    folder = F.regexp_extract("path", "/(customers|events)/", 1)
    return columns.select(folder.alias("folder"), "name", "detected_type", "nullable", "sql_type").filter(
        "folder <> ''").distinct()


def profile_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types found below a folder: marker and hidden files of unknown type are gone."""
    return profile_plan.profile_folder(spark, events_ndjson(spark, sf_dir)).filter("name LIKE 'part-%'").select(
        "file_type", "encoding", "codepage", "error").distinct()


def profile_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explicit list of tables and one missing path: every listed path has its row."""
    listed = data_files(spark, sf_dir).select(F.crc32("path").alias("ordinal"), "path")
    missing = spark.range(1).select(F.lit(-1).cast("bigint").alias("ordinal"),
                                    F.lit(f"{sf_dir}/not-there.csv").alias("path"))
    profiles = profile_plan.profile_paths(listed.unionByName(missing))
    return profiles.groupBy(F.when(F.col("ordinal") < 0, "not there").otherwise(table_of("path")).alias("table")).agg(
        F.sum("row_count").alias("rows"), F.bool_or(F.col("error").isNotNull()).alias("failed")
    )


def preview_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows there are and whether a preview of 1000 leaves some out, per table."""
    info = preview_plan.preview_info(profile_plan.profile_location(spark, sf_dir), 1000)
    tables = info.filter((table_of("path") != "") & F.col("path").endswith(".parquet"))
    return tables.groupBy(table_of("path").alias("table")).agg(
        F.sum("total_rows").alias("rows"), F.bool_or("truncated").alias("more"),
        F.max(F.size("columns")).cast("bigint").alias("columns"),
    )


def profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of one path."""
    path = data_files(spark, sf_dir).filter(table_of("path") == "orders").agg(F.min("path")).first()[0]
    found = profile_plan.profile_location(spark, sf_dir).filter(F.col("path") == path)
    return found.select("file_type", "encoding", "codepage", "column_count", "compression")


def profile_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken files give error rows; the others are profiled."""

    def write(path: str) -> None:
        orders = table(spark, sf_dir, "orders")
        cut = orders.select(F.concat(F.lit("{not valid json "), "o_orderkey").alias("value"))
        write_files(cut, f"{path}/broken", ".json", lambda frame: "\n".join(frame["value"]).encode())
        orders.select("o_orderkey").write.json(f"{path}/sound")

    root = once(spark, sf_dir, "broken-lake", write)
    profiles = profile_plan.profile_location(spark, root).filter("name LIKE 'part-%'")
    folder = F.regexp_extract("path", "/(broken|sound)/", 1)
    return profiles.groupBy(folder.alias("folder")).agg(
        F.bool_and(F.col("error").isNotNull()).alias("failed"), F.max("file_type").alias("file_type"),
        F.sum("row_count").alias("rows"),
    )


def detect_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of a flat listing: table folders by their marks, files by extension."""
    tagged = listing_ops.tag_table_files(listing(spark, sf_dir))
    file_type = F.coalesce("table_type", type_by_extension(F.regexp_extract("path", "([^/]*)$", 1)), F.lit("unknown"))
    return tagged.select("path", file_type.alias("file_type"))


def table_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat listing with table folders collapsed to one entry."""
    tagged = listing_ops.tag_table_files(listing(spark, sf_dir))
    return listing_ops.collapse_listing(tagged)


def dir_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing_ops.folder_sizes(listing(spark, sf_dir), include_hidden=False)


def pruned_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing_ops.prune_hidden(listing(spark, sf_dir)).select("path", "size")


def incremental_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that changed since they were last profiled: new, newer or resized."""
    now = listing(spark, sf_dir)
    before = now.filter("modified % 9 <> 0").withColumn(
        "size", F.expr("CASE WHEN modified % 10 = 0 THEN size + 1 ELSE size END")
    )
    return listing_ops.changed_files(now, before).select("path", "size")


def profile_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh profiles replace old ones of the same path; the rest stay."""
    now = listing(spark, sf_dir)
    old = now.filter("modified % 3 <> 0").select("path", F.lit("old").alias("state"), "size")
    fresh = now.filter("modified % 2 = 0").select("path", F.lit("fresh").alias("state"))
    return listing_ops.upsert_profiles(old, fresh)


def excel_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of workbooks written from the orders, back as rows."""
    path = once(spark, sf_dir, "order-workbooks", lambda where: write_workbooks(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), where))
    cells = workbook.workbook_cells(inventory(spark, path).filter("extension = '.xlsx'"))
    rows = cells.filter("row > 1").groupBy("path", "row").agg(
        F.max(F.when(F.col("col") == 1, F.col("value"))).cast("bigint").alias("o_orderkey"),
        F.max(F.when(F.col("col") == 2, F.col("value"))).alias("o_orderstatus"),
        F.max(F.when(F.col("col") == 3, F.col("value"))).cast("double").alias("o_totalprice"),
    )
    return rows.drop("path", "row")


def excel_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column profiles of the first sheets."""
    path = once(spark, sf_dir, "order-workbooks", lambda where: write_workbooks(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), where))
    profiles = profile_plan.profile_location(spark, path).filter("file_type = 'excel'")
    return profile_plan.column_profiles(profiles).select(
        F.col("ordinal").cast("bigint").alias("ordinal"), "name", "detected_type").distinct()


QUERIES = {
    "location_summary": location_summary,
    "whole_encoding": whole_encoding,
    "lake_scan": lake_scan,
    "inventory_list": inventory_list,
    "file_attributes": file_attributes,
    "list_level": list_level,
    "parquet_footer": parquet_footer,
    "profile_file": profile_file,
    "profile_columns": profile_columns,
    "profile_folder": profile_folder,
    "profile_paths": profile_paths,
    "preview_info": preview_info,
    "profile_lookup": profile_lookup,
    "profile_errors": profile_errors,
    "detect_type": detect_type,
    "table_roots": table_roots,
    "dir_size": dir_size,
    "pruned_listing": pruned_listing,
    "incremental_inventory": incremental_inventory,
    "profile_upsert": profile_upsert,
    "excel_cells": excel_cells,
    "excel_profile": excel_profile,
}


def each_table(select: str) -> str:
    return " UNION ALL ".join(select.format(t=name) for name in TABLES)


_OWNER = """
    CASE WHEN path LIKE '%/orders.delta/%' THEN regexp_extract(path, '^(.*/orders\\.delta)/', 1)
         -- A folder of data files is a table only where a metadata file was listed too.
         WHEN path LIKE '%\\_ice/%' ESCAPE '\\' THEN regexp_extract(path, '^(.*_ice)/', 1) END
"""
_TAGGED = f"""
    SELECT l.*, CASE WHEN r.root IS NOT NULL THEN l.owner END AS table_root, r.kind AS table_type
    FROM (SELECT *, {_OWNER} AS owner FROM ({LISTING})) l
    LEFT JOIN (SELECT {_OWNER} AS root,
                      CASE WHEN max(path LIKE '%/\\_delta\\_log/%' ESCAPE '\\') THEN 'delta' ELSE 'iceberg' END AS kind
               FROM ({LISTING}) WHERE path LIKE '%/\\_delta\\_log/%' ESCAPE '\\' OR path LIKE '%.metadata.json'
               GROUP BY 1) r ON l.owner = r.root
"""

ORACLES = {
    "lake_scan": """
        SELECT ['dialects/a', 'dialects/b', 'lines', 'arrays', 'columns/orc', 'columns/parquet', 'names'][n + 1] AS folder,
               CASE WHEN n < 6 THEN c_custkey END AS c_custkey, CASE WHEN n < 6 THEN c_name || CASE WHEN n = 1 THEN '€' ELSE '' END END AS c_name,
               CASE WHEN n < 6 THEN c_nationkey::BIGINT END AS c_nationkey, CASE WHEN n < 6 THEN c_acctbal END AS c_acctbal,
               CASE WHEN n < 6 AND n <> 3 THEN c_mktsegment END AS c_mktsegment, CASE WHEN n = 6 THEN c_name END AS line
        FROM (SELECT *, c_custkey % 7 AS n FROM customer)""",
    "whole_encoding": """
        SELECT folder, encoding, encoding_confidence, encoding_warning, lines
        FROM (VALUES ('ascii', 'ascii', 100::BIGINT, NULL), ('utf-8', 'utf-8', 99, NULL), ('cp1252', 'cp1252', 50, NULL),
                     ('latin-1', 'latin-1', 40, 'Low confidence (40%) for encoding "latin-1". Verify encoding manually or specify it explicitly.'))
             v(folder, encoding, encoding_confidence, encoding_warning),
             (SELECT sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM documents)""",
    "location_summary": f"""
        SELECT 'parquet' AS file_type, {len(TABLES)}::BIGINT AS tables, sum(n)::BIGINT AS total_rows, 0::BIGINT AS failed,
               true AS has_bytes
        FROM ({each_table('SELECT count(*) AS n FROM {t}')})""",
    "inventory_list": each_table("SELECT '{t}' AS \"table\", '.parquet' AS extension, 'local' AS scheme, "
                                 "false AS is_table_root"),
    "file_attributes": each_table("SELECT '{t}' AS \"table\", true AS has_size, true AS has_time, true AS missing_reported"),
    "list_level": """
        SELECT unnest(['customers', 'documents', 'events', 'orders', 'texts', 'sales.delta']) AS name,
               unnest(['folder', 'folder', 'folder', 'folder', 'folder', 'table']) AS kind,
               unnest([NULL, NULL, NULL, NULL, NULL, 'delta']) AS file_type""",
    "parquet_footer": each_table("SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS rows, "
                                 "(SELECT count(*) FROM (DESCRIBE SELECT * FROM {t})) AS columns"),
    "profile_file": f"""
        SELECT 'customers' AS folder, 'csv' AS file_type, count(*)::BIGINT AS rows, 5::BIGINT AS columns, 0::BIGINT AS failed
        FROM customer
        UNION ALL SELECT 'documents', 'csv', count(*), 3, 0 FROM documents
        UNION ALL SELECT 'events', 'json', count(*), 4, 0 FROM events
        UNION ALL SELECT 'orders', 'parquet', count(*), 6, 0 FROM orders
        UNION ALL SELECT 'texts', 'text', sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT, NULL, 0 FROM documents
        UNION ALL SELECT 'sales.delta', 'delta', NULL, 2, 0""",
    "profile_columns": """
        SELECT folder, name, detected_type, true AS nullable, sql_type FROM (VALUES
            ('customers', 'c_custkey', 'int64', 'BIGINT'), ('customers', 'c_name', 'object', 'NVARCHAR(255)'),
            ('customers', 'c_nationkey', 'int64', 'BIGINT'), ('customers', 'c_acctbal', 'float64', 'FLOAT'),
            ('customers', 'c_mktsegment', 'object', 'NVARCHAR(255)'), ('events', 'event_id', 'int', 'INT'),
            ('events', 'user_id', 'int', 'INT'), ('events', 'event_type', 'str', 'NVARCHAR(255)'),
            ('events', 'value', 'float', 'FLOAT')) t(folder, name, detected_type, sql_type)""",
    "profile_folder": "SELECT 'text' AS file_type, 'ascii' AS encoding, '1252' AS codepage, NULL::VARCHAR AS error",
    "profile_paths": each_table("SELECT '{t}' AS \"table\", count(*) AS rows, false AS failed FROM {t}")
    + " UNION ALL SELECT 'not there', NULL, true",
    "preview_info": each_table("SELECT '{t}' AS \"table\", count(*) AS rows, count(*) > 1000 AS more, "
                               "(SELECT count(*) FROM (DESCRIBE SELECT * FROM {t})) AS columns FROM {t}"),
    "profile_lookup": """
        SELECT 'parquet' AS file_type, 'binary' AS encoding, 'ACP' AS codepage, 6::BIGINT AS column_count,
               'SNAPPY' AS compression""",
    "profile_errors": """
        SELECT 'broken' AS folder, true AS failed, 'json' AS file_type, NULL::BIGINT AS rows
        UNION ALL SELECT 'sound', false, 'json', count(*) FROM orders""",
    "detect_type": f"""
        SELECT path, coalesce(table_type, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1))
                   WHEN '.csv' THEN 'csv' WHEN '.jsonl' THEN 'json' WHEN '.txt' THEN 'text' WHEN '.parquet' THEN 'parquet'
                   WHEN '.json' THEN 'json' ELSE 'unknown' END) AS file_type
        FROM ({_TAGGED})""",
    "table_roots": f"""
        SELECT coalesce(table_root, path) AS path, coalesce(table_type, 'file') AS entry_type, count(*) AS files,
               sum(size)::BIGINT AS size
        FROM ({_TAGGED}) GROUP BY 1, 2""",
    "dir_size": f"""
        SELECT folder, count(*) AS files, sum(size)::BIGINT AS size
        FROM (SELECT size, unnest(list_transform(range(2, len(parts)), lambda n: array_to_string(parts[1:n], '/'))) AS folder
              FROM (SELECT size, string_split(path, '/') AS parts FROM ({LISTING}) WHERE NOT regexp_matches(path, '/\\.[^/]*$')))
        GROUP BY 1""",
    "pruned_listing": f"""
        SELECT path, size FROM ({LISTING}) WHERE path NOT LIKE '/lake/.hidden/%' AND path NOT LIKE '%\\_\\_pycache\\_\\_%' ESCAPE '\\'""",
    "incremental_inventory": f"SELECT path, size FROM ({LISTING}) WHERE modified % 9 = 0 OR modified % 10 = 0",
    "profile_upsert": f"""
        SELECT path, CASE WHEN modified % 2 = 0 THEN 'fresh' ELSE 'old' END AS state,
               CASE WHEN modified % 2 = 0 THEN NULL ELSE size END AS size
        FROM ({LISTING}) WHERE modified % 2 = 0 OR modified % 3 <> 0""",
    "excel_cells": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "excel_profile": """
        SELECT * FROM (VALUES (1::BIGINT, 'o_orderkey', 'int64'), (2::BIGINT, 'o_orderstatus', 'object'),
                              (3::BIGINT, 'o_totalprice', 'float64')) t(ordinal, name, detected_type)""",
}
