"""Definitions, settings, methods, advice and warnings from profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeprofile import lookups
from lakeprofile.functions.names import escape_bracketed
from lakeprofile.operators import advice, columns as column_ops, ddl, export
from lakeprofile.plans.report import file_report as report
from lakeprofile.session import scratch_path
from queries.fixtures import PROFILE_COLUMNS, PROFILE_FILES, profiles, table
from queries.names import sql_case


def column_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select("path", F.array_join(ddl.column_definitions("columns"), ", ").alias("ddl"))


def create_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select(
        "path", ddl.create_table(F.concat(F.lit("t"), F.col("doc_id")), "columns").alias("create_table")
    )


def openjson_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select("path", F.array_join(ddl.openjson_columns("columns"), ", ").alias("ddl"))


def reader_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = ddl.reader_options("file_type", "delimiter", "has_header", "encoding", "json_format", "quoted_breaks")
    return profiles(spark, sf_dir).select(
        "path", ddl.reader_format("file_type").alias("format"), options["sep"].alias("sep"),
        options["header"].alias("header"), options["encoding"].alias("charset"), options["multiLine"].alias("multi_line"),
    )


def file_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = ddl.file_format("file_type", "delimiter", "has_header", "encoding", "compression")
    return profiles(spark, sf_dir).select("path", settings.alias("f"), ddl.format_keyword("file_type").alias("keyword")) \
        .select("path", "keyword", "f.format_type", "f.field_terminator", "f.string_delimiter",
                F.col("f.first_row").cast("bigint").alias("first_row"), "f.encoding", "f.data_compression",
                "f.serde_method")


def load_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = advice.load_methods(profiles(spark, sf_dir))
    return found.select("path", "platform", F.col("position").cast("bigint").alias("position"), "method")


def unavailable_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advice.unavailable_methods(profiles(spark, sf_dir), "sql_server_2019").select("path", "method", "alternative")


def load_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profiles(spark, sf_dir)
    return rows.select(
        "path",
        advice.load_advice(F.col("file_type"), F.col("size"), "sql_server_2022").alias("a"),
        advice.load_advice(F.col("file_type"), F.col("size"), "sql_server_2019").alias("b"),
    ).select("path", "a.best", "a.fastest", "a.cheapest", "a.staging", F.col("b.best").alias("best_2019"))


def profile_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advice.profile_warnings(profiles(spark, sf_dir)).select("path", "warning")


def export_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written script, line by line, counted."""
    defined = ddl.with_definitions(profiles(spark, sf_dir), F.concat(F.lit("ext_t"), F.col("doc_id")))
    path = scratch_path(spark, "report-sql")
    export.export_sql(defined, path)
    lines = spark.read.text(path).select(F.rtrim("value").alias("line"))
    return lines.filter("line <> ''").groupBy("line").agg(F.count("*").alias("lines"))


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written report, read back."""
    path = scratch_path(spark, "report-json")
    export.export_json(profiles(spark, sf_dir).select("path", "file_type", "size", "compression"), path)
    return spark.read.schema("path string, file_type string, size bigint, compression string").json(path)


def file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All outputs per file, reduced to what tells them apart."""
    rows = profiles(spark, sf_dir)
    return report(rows).select(
        "path", "table_name", F.size("load_methods").cast("bigint").alias("methods"),
        F.coalesce(F.size("warnings"), F.lit(0)).cast("bigint").alias("warnings"),
        "file_format.format_type", "reader_format", F.col("create_table").isNotNull().alias("defined"),
        F.array_join("sample", "/").alias("sample"),
    )


def schema_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_ops.apply_overrides(table(spark, sf_dir, "customer"), {
        "c_name": {"name": "customer"}, "c_acctbal": {"excluded": True}, "c_nationkey": {"type": "bigint", "name": "nation"},
        "c_custkey": {"type": "string", "nullable": False},
    })


def manual_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read under a schema given by hand."""
    schema = column_ops.schema_of_columns([("o_orderkey", "bigint"), ("o_orderstatus", "string"), ("o_custkey", "bigint")])
    return spark.read.schema(schema).parquet(f"{sf_dir}/orders.parquet")


def profile_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions after columns were renamed, left out, retyped and made nullable."""
    changed = column_ops.override_profiles(profiles(spark, sf_dir), {
        "col0": {"name": "first", "type": "DECIMAL(18,4)"}, "col1": {"nullable": True, "type": "INT; DROP TABLE x"},
        "col2": {"excluded": True},
    })
    return changed.select("path", F.array_join(ddl.column_definitions("columns"), ", ").alias("ddl"))


def escaped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column rows of all profiles with their escaped names."""
    columns = profiles(spark, sf_dir).select("path", F.inline("columns"))
    return columns.select("path", F.col("ordinal").cast("bigint").alias("ordinal"),
                          escape_bracketed("name").alias("name"), "sql_type")


QUERIES = {
    "column_ddl": column_ddl,
    "create_table": create_table,
    "openjson_columns": openjson_columns,
    "reader_options": reader_options,
    "file_format": file_format,
    "load_methods": load_methods,
    "unavailable_methods": unavailable_methods,
    "load_advice": load_advice,
    "profile_warnings": profile_warnings,
    "export_sql": export_sql,
    "export_json": export_json,
    "file_report": file_report,
    "schema_override": schema_override,
    "profile_override": profile_override,
    "manual_schema": manual_schema,
    "escaped_columns": escaped_columns,
}

_NAME = "'[' || replace(name, ']', ']]') || '] '"
_NULLABLE_LINE = f"{_NAME} || rpad(sql_type, greatest(22, length(sql_type))::INT, ' ') || CASE WHEN nullable THEN ' NULL' ELSE ' NOT NULL' END"
_FORMAT = sql_case("file_type", lookups.EXTERNAL_FORMATS, "'DELIMITEDTEXT'")
_METHODS = f"""
    SELECT f.path, f.file_type, p.platform, m.method, m.preference,
           CASE m.method
               WHEN 'bulk_insert' THEN f.file_type IN ('csv', 'text') AND p.platform <> 'fabric_sql_db'
               WHEN 'openrowset' THEN f.file_type NOT IN ('parquet', 'delta')
                                      OR p.platform IN ('sql_server_2022', 'sql_server_2025')
                                      OR (f.file_type = 'parquet' AND p.platform <> 'sql_server_2019')
               WHEN 'external_table' THEN CASE {_FORMAT}
                   WHEN 'DELIMITEDTEXT' THEN p.platform IN ('sql_server_2019', 'sql_server_2022', 'sql_server_2025')
                   WHEN 'PARQUET' THEN p.platform IN ('sql_server_2022', 'sql_server_2025')
                   WHEN 'DELTA' THEN p.platform IN ('sql_server_2022', 'sql_server_2025')
                   WHEN 'JSON' THEN false ELSE p.platform = 'sql_server_2019' END
               WHEN 'openjson' THEN f.file_type = 'json' ELSE true END AS available
    FROM ({PROFILE_FILES}) f
    CROSS JOIN (SELECT unnest(['sql_server_2019', 'sql_server_2022', 'sql_server_2025', 'azure_sql_db', 'azure_sql_mi',
                               'fabric_sql_db']) AS platform) p
    CROSS JOIN (SELECT unnest(['bulk_insert', 'openrowset', 'external_table', 'openjson', 'for_json']) AS method,
                       unnest([1, 2, 3, 4, 5]) AS preference) m
"""
_WARNINGS = f"""
    SELECT path, 'Low encoding confidence (50%). Verify file encoding before loading.' AS warning
    FROM ({PROFILE_FILES}) WHERE encoding_confidence < 70
    UNION ALL
    SELECT path, 'Row count is estimated. Validate with a post-load COUNT(*) query.' FROM ({PROFILE_FILES})
    WHERE row_count_estimated
    UNION ALL
    SELECT DISTINCT path, 'Nested JSON detected. Expect flattening or OPENJSON WITH (...) work before production load.'
    FROM ({PROFILE_COLUMNS}) WHERE file_type = 'json' AND nesting = 'object'
    UNION ALL
    SELECT DISTINCT path, 'Very long strings detected. Consider NVARCHAR(MAX) columns and downstream truncation checks.'
    FROM ({PROFILE_COLUMNS}) WHERE sized_len > 4000
    UNION ALL
    SELECT path, 'Nullable numeric columns detected: ' || string_agg(name, ', ' ORDER BY ordinal)
           || '. Stage as text if source quality is inconsistent.'
    FROM ({PROFILE_COLUMNS}) WHERE nullable AND detected_type IN ('int64', 'float64') GROUP BY path
"""
_EXTERNAL_LINES = f"""
    SELECT unnest(string_split(
        '-- File: ' || f.path || chr(10) || '-- Type: ' || f.file_type || chr(10)
        || 'CREATE EXTERNAL TABLE [dbo].[ext_t' || f.doc_id || ']' || chr(10) || '(' || chr(10) || c.lines || chr(10) || ')'
        || chr(10) || 'WITH' || chr(10) || '(' || chr(10) || '    DATA_SOURCE = [MyDataSource],' || chr(10)
        || '    LOCATION = ''' || f.path || ''',' || chr(10) || '    FILE_FORMAT = [ff_' || f.file_type || '_format],'
        || chr(10) || '    REJECT_TYPE = VALUE,' || chr(10) || '    REJECT_VALUE = 0' || chr(10) || ');', chr(10))) AS line
    FROM ({PROFILE_FILES}) f
    JOIN (SELECT path, string_agg('    ' || {_NAME} || sql_type, ',' || chr(10) ORDER BY ordinal) AS lines
          FROM ({PROFILE_COLUMNS}) GROUP BY path) c USING (path)
"""

ORACLES = {
    "column_ddl": f"SELECT path, string_agg({_NULLABLE_LINE}, ', ' ORDER BY ordinal) AS ddl FROM ({PROFILE_COLUMNS}) GROUP BY path",
    "create_table": f"""
        SELECT path, 'CREATE TABLE [dbo].[t' || doc_id || ']' || chr(10) || '(' || chr(10)
               || string_agg('    ' || {_NULLABLE_LINE}, ',' || chr(10) ORDER BY ordinal) || chr(10) || ');' AS create_table
        FROM ({PROFILE_COLUMNS}) GROUP BY path, doc_id""",
    "openjson_columns": f"""
        SELECT path, string_agg({_NAME} || CASE WHEN nesting = 'object' THEN 'NVARCHAR(MAX)' ELSE sql_type END || ' '''
                   || CASE WHEN regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$') THEN '$.' || name
                           ELSE '$."' || name || '"' END || '''' || CASE WHEN nesting = 'object' THEN ' AS JSON' ELSE '' END,
                   ', ' ORDER BY ordinal) AS ddl
        FROM ({PROFILE_COLUMNS}) GROUP BY path""",
    "reader_options": f"""
        SELECT path, CASE file_type WHEN 'delta' THEN 'parquet' WHEN 'iceberg' THEN 'parquet'
                          WHEN 'rc' THEN NULL WHEN 'excel' THEN NULL WHEN 'unknown' THEN NULL ELSE file_type END AS format,
               CASE WHEN file_type = 'csv' THEN delimiter END AS sep,
               CASE WHEN file_type = 'csv' THEN has_header::VARCHAR END AS header,
               CASE WHEN file_type IN ('csv', 'json') THEN
                    CASE encoding WHEN 'cp1252' THEN 'windows-1252' ELSE 'UTF-8' END END AS charset,
               CASE file_type WHEN 'json' THEN (json_format <> 'ndjson')::VARCHAR
                              WHEN 'csv' THEN (doc_id % 3 = 0)::VARCHAR END AS multi_line
        FROM ({PROFILE_FILES})""",
    "file_format": f"""
        SELECT path, CASE file_type WHEN 'parquet' THEN 'PARQUET' WHEN 'delta' THEN 'DELTA' WHEN 'orc' THEN 'ORC'
                          ELSE 'CSV' END AS keyword,
               {_FORMAT} AS format_type,
               CASE WHEN file_type = 'csv' THEN replace(delimiter, chr(9), '\\t')
                    WHEN {_FORMAT} = 'DELIMITEDTEXT' THEN '\\n' END AS field_terminator,
               CASE WHEN file_type = 'csv' THEN '"' END AS string_delimiter,
               CASE WHEN file_type = 'csv' AND has_header THEN 2 ELSE 1 END::BIGINT AS first_row,
               CASE WHEN {_FORMAT} = 'DELIMITEDTEXT' AND encoding = 'cp1252' THEN 'CP1252' ELSE 'UTF8' END AS encoding,
               CASE WHEN {_FORMAT} IN ('PARQUET', 'ORC', 'RCFILE') THEN CASE upper(compression)
                    WHEN 'SNAPPY' THEN 'org.apache.hadoop.io.compress.SnappyCodec'
                    WHEN 'GZIP' THEN 'org.apache.hadoop.io.compress.GzipCodec' END END AS data_compression,
               CASE WHEN file_type = 'rc' THEN 'org.apache.hadoop.hive.serde2.columnar.ColumnarSerDe' END AS serde_method
        FROM ({PROFILE_FILES})""",
    "load_methods": f"""
        SELECT path, platform, row_number() OVER (PARTITION BY path, platform ORDER BY preference) AS position, method
        FROM ({_METHODS}) WHERE available""",
    "unavailable_methods": f"""
        SELECT path, method, alternative
        FROM (SELECT *, arg_min(method, preference) FILTER (available) OVER (PARTITION BY path) AS alternative
              FROM ({_METHODS}) WHERE platform = 'sql_server_2019')
        WHERE NOT available""",
    "load_advice": f"""
        SELECT path,
               CASE WHEN file_type IN ('csv', 'text') THEN 'BULK INSERT for load, then validate in SQL'
                    WHEN file_type = 'json' THEN 'Load JSON as text with OPENROWSET(SINGLE_CLOB), then parse with OPENJSON'
                    WHEN file_type IN ('parquet', 'delta')
                        THEN 'OPENROWSET FORMAT=''' || upper(file_type) || ''' over ABS, ADLS, or S3 storage'
                    ELSE 'CREATE TABLE + INSERT validation flow' END AS best,
               CASE WHEN file_type IN ('csv', 'text') THEN 'BULK INSERT for local or staged CSV/text files'
                    WHEN file_type = 'json' THEN 'OPENJSON after loading the file as NVARCHAR(MAX)'
                    WHEN file_type IN ('parquet', 'delta') THEN 'OPENROWSET with projected columns'
                    ELSE 'OPENROWSET for preview / exploratory access' END AS fastest,
               'OPENROWSET with projection/filtering' AS cheapest,
               CASE WHEN size / 1048576.0 > 512 THEN 'For large files, land data in staging and validate in batches'
                    WHEN size / 1048576.0 < 25 THEN 'For small files, direct load is fine, but keep a validation query ready'
                    ELSE 'Load to a staging table first, then transform into the final schema' END AS staging,
               CASE WHEN file_type IN ('csv', 'text') THEN 'BULK INSERT for load, then validate in SQL'
                    WHEN file_type = 'json' THEN 'Load JSON as text with OPENROWSET(SINGLE_CLOB), then parse with OPENJSON'
                    WHEN file_type = 'parquet' THEN 'Parquet is not supported; convert to CSV before loading'
                    WHEN file_type = 'delta' THEN 'Delta is not supported; convert to CSV before loading'
                    ELSE 'CREATE TABLE + INSERT validation flow' END AS best_2019
        FROM ({PROFILE_FILES})""",
    "profile_warnings": _WARNINGS,
    "export_sql": f"SELECT line, count(*) AS lines FROM ({_EXTERNAL_LINES}) GROUP BY line",
    "export_json": f"SELECT path, file_type, size, compression FROM ({PROFILE_FILES})",
    "file_report": f"""
        SELECT f.path, 'ext_tbl_' || doc_id AS table_name, methods, coalesce(w.warnings, 0) AS warnings, {_FORMAT} AS format_type,
               CASE file_type WHEN 'delta' THEN 'parquet' WHEN 'iceberg' THEN 'parquet'
                          WHEN 'rc' THEN NULL WHEN 'excel' THEN NULL WHEN 'unknown' THEN NULL ELSE file_type END AS reader_format,
               true AS defined, sample
        FROM ({PROFILE_FILES}) f
        JOIN (SELECT path, CASE WHEN c.file_type = 'json'
                                THEN string_agg(name || ': ' || substring('v ' || repeat(c.doc_id::VARCHAR, 40), 1, 60),
                                                '/' ORDER BY ordinal)
                                ELSE string_agg(name, ' | ' ORDER BY ordinal) || '/' || any_value(source) || ' | '
                                     || any_value(lang) END AS sample
              FROM ({PROFILE_COLUMNS}) c JOIN documents USING (doc_id) GROUP BY path, c.file_type, c.doc_id) s USING (path)
        JOIN (SELECT path, count(*) AS methods FROM ({_METHODS}) WHERE available AND platform = 'sql_server_2022'
              GROUP BY path) m USING (path)
        LEFT JOIN (SELECT path, count(*) AS warnings FROM ({_WARNINGS}) GROUP BY path) w USING (path)""",
    "schema_override": """
        SELECT c_custkey::VARCHAR AS c_custkey, c_name AS customer, c_nationkey::BIGINT AS nation, c_mktsegment FROM customer""",
    "profile_override": f"""
        SELECT path, string_agg({_NULLABLE_LINE}, ', ' ORDER BY ordinal) AS ddl
        FROM (SELECT path, ordinal, CASE name WHEN 'col0' THEN 'first' ELSE name END AS name,
                     CASE name WHEN 'col0' THEN 'DECIMAL(18,4)' WHEN 'col1' THEN 'NVARCHAR(MAX)' ELSE sql_type END AS sql_type,
                     nullable OR name = 'col1' AS nullable
              FROM ({PROFILE_COLUMNS}) WHERE name <> 'col2')
        GROUP BY path""",
    "manual_schema": "SELECT o_orderkey, o_orderstatus, o_custkey FROM orders",
    "escaped_columns": f"SELECT path, ordinal, replace(name, ']', ']]') AS name, sql_type FROM ({PROFILE_COLUMNS})",
}
