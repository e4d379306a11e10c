"""Table definitions and reader settings derived from profiles, as columns of the profile row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakeprofile.functions.lookup import as_column, look_up
from lakeprofile.functions.names import escape_bracketed, escape_literal, json_path, shown_delimiter
from lakeprofile.lookups import CODEC_CLASSES, EXTERNAL_FORMATS, FORMAT_KEYWORDS, LONG_STRING, RC_SERDE, READER_CHARSETS


def column_definitions(columns: Column | str, with_nullability: bool = True) -> Column:
    """Array of ``[name] TYPE NULL`` lines from column structs (``name, sql_type, nullable``), in schema order."""

    def line(column: Column) -> Column:
        name = F.concat(F.lit("["), escape_bracketed(column["name"]), F.lit("] "))
        if not with_nullability:
            return F.concat(name, column["sql_type"])
        # Types line up in a 22-character field.
        padded = F.when(F.length(column["sql_type"]) < 22, F.rpad(column["sql_type"], 22, " ")).otherwise(
            column["sql_type"]
        )
        return F.concat(name, padded, F.when(column["nullable"], " NULL").otherwise(" NOT NULL"))

    return F.transform(as_column(columns), line)


def repeated_column(columns: Column | str) -> Column:
    """First name that repeats an earlier one when case is ignored, else null."""
    columns = as_column(columns)
    names = F.transform(columns, lambda column: F.lower(column["name"]))
    later = F.filter(columns, lambda column, at: F.array_position(names, F.lower(column["name"])) < at + 1)
    return F.get(later, F.lit(0))["name"]


def _definition_text(columns: Column, with_nullability: bool) -> Column:
    fallback = F.lit("    [data] NVARCHAR(MAX)" + (" NULL" if with_nullability else ""))
    lines = F.transform(column_definitions(columns, with_nullability), lambda line: F.concat(F.lit("    "), line))
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.array_join(lines, ",\n")).otherwise(fallback)


def create_table(table: Column | str, columns: Column | str, schema: str = "dbo") -> Column:
    """``CREATE TABLE`` text; one wide text column where the schema is unknown."""
    return F.concat(
        F.lit(f"CREATE TABLE [{schema.replace(']', ']]')}].["), escape_bracketed(table), F.lit("]\n(\n"),
        _definition_text(as_column(columns), True), F.lit("\n);"),
    )


def external_table(table: Column | str, columns: Column | str, location: Column | str, file_type: Column | str,
                   data_source: str = "MyDataSource", schema: str = "dbo") -> Column:
    """``CREATE EXTERNAL TABLE`` text over a file, with no rejected rows allowed."""
    quoted = lambda name: name.replace("]", "]]")
    return F.concat(
        F.lit(f"CREATE EXTERNAL TABLE [{quoted(schema)}].["), escape_bracketed(table), F.lit("]\n(\n"),
        _definition_text(as_column(columns), False),
        F.lit(f"\n)\nWITH\n(\n    DATA_SOURCE = [{quoted(data_source)}],\n    LOCATION = '"),
        escape_literal(location), F.lit("',\n    FILE_FORMAT = [ff_"), as_column(file_type),
        F.lit("_format],\n    REJECT_TYPE = VALUE,\n    REJECT_VALUE = 0\n);"),
    )


def openjson_columns(columns: Column | str) -> Column:
    """Array of ``OPENJSON ... WITH`` column lines; nested members stay JSON text."""

    def line(column: Column) -> Column:
        nested = F.coalesce(column["nesting"].isin("object", "array"), F.lit(False))
        return F.concat(
            F.lit("["), escape_bracketed(column["name"]), F.lit("] "),
            F.when(nested, LONG_STRING).otherwise(column["sql_type"]),
            F.lit(" '"), json_path(column["name"]), F.lit("'"), F.when(nested, " AS JSON").otherwise(""),
        )

    return F.transform(as_column(columns), line)


def external_format(file_type: Column | str) -> Column:
    return F.coalesce(look_up(file_type, EXTERNAL_FORMATS), F.lit("DELIMITEDTEXT"))


def format_keyword(file_type: Column | str) -> Column:
    return F.coalesce(look_up(file_type, FORMAT_KEYWORDS), F.lit("CSV"))


def file_format(file_type: Column | str, delimiter: Column | str, has_header: Column | str, encoding: Column | str,
                compression: Column | str) -> Column:
    """Struct of external file-format settings: type, terminator, quote, first row, encoding, codec, SerDe."""
    file_type = as_column(file_type)
    is_csv = file_type == "csv"
    kind = external_format(file_type)
    upper = F.upper(F.coalesce(as_column(encoding), F.lit("utf-8")))
    keyword = (
        F.when(upper.isin("UTF-8", "UTF_8", "UTF8-SIG", "UTF-8-SIG"), "UTF8")
        .when(upper.isin("UTF-16", "UTF_16"), "UTF16")
        .otherwise(upper)
    )
    delimited = kind == "DELIMITEDTEXT"
    terminator = F.when(F.coalesce(as_column(delimiter), F.lit("")) == "", ",").otherwise(
        F.replace(as_column(delimiter), F.lit("\t"), F.lit("\\t"))
    )
    codec = look_up(F.upper(F.coalesce(as_column(compression), F.lit(""))), CODEC_CLASSES)
    return F.struct(
        kind.alias("format_type"),
        F.when(is_csv, terminator).when(delimited, "\\n").alias("field_terminator"),
        F.when(is_csv, '"').alias("string_delimiter"),
        F.when(is_csv & as_column(has_header), 2).otherwise(1).alias("first_row"),
        F.when(delimited, keyword).otherwise("UTF8").alias("encoding"),
        F.when(kind.isin("PARQUET", "ORC", "RCFILE"), codec).alias("data_compression"),
        F.when(kind == "RCFILE", RC_SERDE).alias("serde_method"),
    )


def reader_format(file_type: Column | str) -> Column:
    """Name for ``spark.read.format``, null where Spark alone cannot read the type."""
    return look_up(file_type, {"csv": "csv", "json": "json", "parquet": "parquet", "delta": "parquet", "orc": "orc",
                               "text": "text", "iceberg": "parquet"})


def reader_options(file_type: Column | str, delimiter: Column | str, has_header: Column | str,
                   encoding: Column | str, json_format: Column | str, quoted_breaks: Column | str) -> Column:
    """Options for ``spark.read`` as a map; empty for self-describing formats.

    Only delimited files with line breaks inside fields are read whole; all others can be split.
    """
    charset = F.coalesce(look_up(encoding, READER_CHARSETS), F.upper(as_column(encoding)), F.lit("UTF-8"))
    csv_options = F.create_map(
        F.lit("sep"), F.coalesce(as_column(delimiter), F.lit(",")),
        F.lit("header"), as_column(has_header).cast("string"),
        F.lit("encoding"), charset, F.lit("quote"), F.lit('"'), F.lit("escape"), F.lit('"'),
        F.lit("multiLine"), F.coalesce(as_column(quoted_breaks), F.lit(False)).cast("string"),
    )
    json_options = F.create_map(
        F.lit("multiLine"), (~as_column(json_format).eqNullSafe(F.lit("ndjson"))).cast("string"),
        F.lit("encoding"), charset,
    )
    file_type = as_column(file_type)
    return F.when(file_type == "csv", csv_options).when(file_type == "json", json_options).otherwise(
        F.create_map().cast("map<string,string>")
    )


def with_definitions(profiles: DataFrame, table: Column, data_source: str = "MyDataSource") -> DataFrame:
    """Profiles plus table name and definition texts; a repeated column name turns into an error."""
    repeated = repeated_column("columns")
    usable = F.col("error").isNull() & repeated.isNull()
    return profiles.withColumns({
        "table_name": table,
        "create_table": F.when(usable, create_table(table, "columns")),
        "external_table": F.when(usable, external_table(table, "columns", "path", "file_type", data_source)),
        "error": F.coalesce("error", F.concat(F.lit("Duplicate column name: "), repeated)),
    })


def shown_settings(delimiter: Column | str, codepage: Column | str) -> Column:
    """Delimiter and code page as a bulk load names them."""
    return F.struct(shown_delimiter(delimiter).alias("field_terminator"), as_column(codepage).alias("codepage"))
