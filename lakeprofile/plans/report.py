"""All derived outputs of profiled files in one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakeprofile.functions.names import member_lines, readable_size, sample_lines, table_name
from lakeprofile.operators.advice import load_advice, warnings_of, with_load_methods
from lakeprofile.operators.ddl import file_format, openjson_columns, reader_format, reader_options, with_definitions


def file_report(profiles: DataFrame, platform: str = "sql_server_2022",
                data_source: str = "MyDataSource") -> DataFrame:
    """Definitions, reader settings, load methods, advice and warnings per file, in one pass over the profiles."""
    defined = with_load_methods(with_definitions(profiles, table_name("path"), data_source), platform)
    is_json = F.col("file_type") == "json"
    return defined.select(
        "path", "file_type", readable_size("size").alias("size"), "row_count", "table_name", "create_table",
        "external_table",
        F.when(is_json, openjson_columns("columns")).alias("openjson_columns"),
        file_format("file_type", "delimiter", "has_header", "encoding", "compression").alias("file_format"),
        reader_format("file_type").alias("reader_format"),
        reader_options("file_type", "delimiter", "has_header", "encoding", "json_format", "quoted_breaks")
        .alias("reader_options"),
        F.when(is_json, member_lines(F.col("columns"))).otherwise(
            sample_lines(F.col("sample_rows"), F.transform("columns", lambda column: column["name"]))
        ).alias("sample"),
        "load_methods",
        load_advice(F.col("file_type"), F.col("size"), platform).alias("advice"),
        warnings_of(defined).alias("warnings"), "error",
    )
