"""Names, types, encodings and URLs as column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeprofile import lookups
from lakeprofile.functions import encodings, names, paths, sqltypes, urls
from queries.fixtures import STRING_TYPE, TYPE_NAMES, sql_list, table


def sql_case(subject: str, mapping: dict, default: str = "NULL") -> str:
    quoted = lambda value: "'" + str(value).replace("'", "''") + "'"
    branches = " ".join(f"WHEN {quoted(key)} THEN {quoted(value)}" for key, value in mapping.items())
    return f"CASE {subject} {branches} ELSE {default} END"


def clean_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        names.clean_identifier("p_name").alias("from_name"),
        names.clean_identifier(F.concat_ws("-", "p_partkey", "p_brand")).alias("from_key"),
        names.clean_identifier(F.nullif(F.lit(""), F.col("p_type"))).alias("from_empty"),
    )


def table_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", names.table_name("url").alias("table_name"))


def escape_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    bracketed, literal = names.escape_bracketed("html"), names.escape_literal("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.md5(bracketed).alias("bracketed"), F.md5(literal).alias("literal"),
    )


def flatten_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = names.one_line("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(flat).cast("bigint").alias("chars"), F.md5(flat).alias("digest")
    )


def text_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = names.text_prefix("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(cut).cast("bigint").alias("chars"), F.md5(cut).alias("digest")
    )


DELIMITERS = [",", "\t", "|", ";", " ", ":", "\r\n"]


def delimiter_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    delimiter = F.element_at(F.array(*[F.lit(d) for d in DELIMITERS]), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", names.delimiter_name(delimiter).alias("name"), names.shown_delimiter(delimiter).alias("shown")
    )


def format_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.expr("n_chars * CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1024 WHEN 3 THEN 65536 "
                  "ELSE 1073741824 END")
    return table(spark, sf_dir, "documents").select("doc_id", names.readable_size(size).alias("size"))


def sample_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    values = F.array(*[F.col(name).cast("string") for name in lines.columns])
    rendered = names.rendered_row(values, F.array(*[F.lit(name) for name in lines.columns]))
    return lines.select("l_orderkey", "l_linenumber", rendered.alias("r")).select(
        "l_orderkey", "l_linenumber", "r.header", "r.line"
    )


def json_path_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.concat(F.col("p_name"), F.lit('"'), F.col("p_brand"), F.lit("'\\"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", names.json_path("p_type").alias("plain"), names.json_path("p_name").alias("spaced"),
        names.json_path(odd).alias("odd"),
    )


SAFE_TYPE_INPUT = """
    CASE doc_id % 8
        WHEN 0 THEN 'INT'
        WHEN 1 THEN concat('NVARCHAR(', n_chars, ')')
        WHEN 2 THEN concat(' decimal ( ', n_chars, ' , 4 ) ')
        WHEN 3 THEN 'varbinary(max)'
        WHEN 4 THEN concat('INT, [', source, '] AS (1) --')
        WHEN 5 THEN '1BAD'
        WHEN 6 THEN concat('INT; DROP TABLE ', source)
        ELSE ''
    END
"""


def safe_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", names.safe_sql_type(F.expr(SAFE_TYPE_INPUT)).alias("sql_type")
    )


def map_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    detected = F.element_at(F.array(*[F.lit(name) for name in TYPE_NAMES]),
                            (F.col("doc_id") % len(TYPE_NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", sqltypes.sql_type(detected).alias("sql_type"),
        sqltypes.sql_type(detected, F.col("n_chars")).alias("sized_type"),
        sqltypes.spark_type(detected).alias("spark_type"),
    )


def string_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = F.length("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", sqltypes.sized_length(observed).alias("sized"),
        sqltypes.string_type(sqltypes.sized_length(observed)).alias("sql_type"),
    )


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as bytes in five encodings."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr("""
        CASE doc_id % 5
            WHEN 0 THEN encode(text, 'UTF-8')
            WHEN 1 THEN concat(X'EFBBBF', encode(text, 'UTF-8'))
            WHEN 2 THEN encode(text, 'ISO-8859-1')
            WHEN 3 THEN encode(text, 'UTF-16')
            ELSE concat(encode(text, 'ISO-8859-1'), X'819D')
        END""").alias("content"))


def detect_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoded(spark, sf_dir).select("doc_id", encodings.detect_encoding("content").alias("e"))
    return found.select(
        "doc_id", "e.encoding", (F.col("e.confidence") * 100).cast("bigint").alias("confidence"),
        encodings.codepage("e.encoding").alias("codepage"),
    )


def codepage(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.array(*[F.lit(name) for name in [*lookups.CODEPAGES, "koi8-r"]])
    spelled = F.element_at(known, (F.col("doc_id") % (len(lookups.CODEPAGES) + 1) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", encodings.codepage(F.concat(F.lit(" "), F.upper(spelled))).alias("codepage")
    )


def supported_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffixes = F.array(*[F.lit(suffix) for suffix in lookups.EXTENSION_TYPES])
    name = F.concat(F.lit("f"), F.element_at(suffixes, (F.col("doc_id") % len(lookups.EXTENSION_TYPES) + 1).cast("int")))
    return table(spark, sf_dir, "documents").select(paths.type_by_extension(name).alias("file_type")).distinct()


ROUTED_URL = """
    CASE page_id % 6
        WHEN 0 THEN url
        WHEN 1 THEN concat('s3://lake-', page_id, '/', substring(url, 9))
        WHEN 2 THEN concat('azure://box/', replace(substring(url, 9), '/', '%2F'))
        WHEN 3 THEN concat('https://acct', page_id, '.blob.core.windows.net/box/dir/a%20b+', page_id, '.csv')
        WHEN 4 THEN concat('https://acct.blob.core.windows.net.example.org/box/f', page_id, '.csv')
        ELSE concat('/data/in/f', page_id, '.json')
    END
"""


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(ROUTED_URL).alias("u"))


def route_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).select(
        "page_id", urls.storage_kind("u").alias("kind"), urls.connection_key("u").alias("connection"),
        urls.location_name("u").alias("name"),
    )


def parse_object_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).select("page_id", urls.object_address("u", require_key=True).alias("a")).select(
        "page_id", "a.container", F.col("a.key").alias("object_key"), "a.error"
    )


STORAGE_URL = """
    CASE page_id % 6
        WHEN 0 THEN concat('abfss://box@acct.dfs.core.windows.net/raw/', page_id, '.csv')
        WHEN 1 THEN concat('https://acct.blob.core.windows.net/box/raw/', page_id, '.csv')
        WHEN 2 THEN concat('wasbs://acct.blob.core.windows.net/box/', page_id, '.csv')
        WHEN 3 THEN concat('s3://bucket/raw/', page_id, '.csv')
        WHEN 4 THEN ''
        ELSE concat('C:\\\\in\\\\', page_id, '.csv')
    END
"""


def storage_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.expr(STORAGE_URL)
    name = F.concat(F.lit("f"), F.col("page_id"), F.lit(".csv"))
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.data_source_address(url, name, "sql_server_2022").alias("now"),
        urls.data_source_address(url, name, "sql_server_2019").alias("old"),
    ).select(
        "page_id", "now.location", "now.relative_path", F.col("old.location").alias("location_2019"),
        F.col("old.relative_path").alias("relative_path_2019"),
    )


QUERIES = {
    "clean_identifier": clean_identifier,
    "table_name": table_name,
    "escape_names": escape_names,
    "flatten_text": flatten_text,
    "text_prefix": text_prefix,
    "delimiter_name": delimiter_name,
    "format_size": format_size,
    "sample_render": sample_render,
    "json_path_quote": json_path_quote,
    "safe_type": safe_type,
    "map_types": map_types,
    "string_sizing": string_sizing,
    "detect_encoding": detect_encoding,
    "codepage": codepage,
    "supported_types": supported_types,
    "route_url": route_url,
    "parse_object_url": parse_object_url,
    "storage_parts": storage_parts,
}

_CLEAN = "regexp_replace({x}, '[^A-Za-z0-9_]', '_', 'g')"
_IDENTIFIER = (
    f"CASE WHEN {_CLEAN} = '' THEN 'column_1' WHEN regexp_matches({_CLEAN}, '^[0-9]') THEN 'col_' || {_CLEAN} "
    f"ELSE {_CLEAN} END"
)
_FLAT = "regexp_replace(regexp_replace(text, '[\\x00-\\x1f\\x7f\\x{2028}\\x{2029}]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
_JSON_PATH = (
    "replace(CASE WHEN regexp_matches({x}, '^[A-Za-z_][A-Za-z0-9_]*$') THEN '$.' || {x} "
    "ELSE '$.\"' || replace(replace({x}, '\\', '\\\\'), '\"', '\\\"') || '\"' END, '''', '''''')"
)
_TYPE = f"{sql_list(TYPE_NAMES)}[doc_id % {len(TYPE_NAMES)} + 1]"
_SQL_TYPES = {row[0]: row[1] for row in lookups.TYPES}
_SPARK_TYPES = {row[0]: row[2] for row in lookups.TYPES}
# Names that only match by content, worked out by hand from the order of the fixed table.
_BY_CONTENT = {
    "decimal128(12, 2)": "DECIMAL(38,10)", "numeric(9,1)": "DECIMAL(18,4)", "list<element: float>": "FLOAT",
    "struct<a: int64>": "BIGINT", "interval": "INT", "timestamp[ms]": "DATETIME2(7)", "unheard-of": "NVARCHAR(255)",
    "object": "NVARCHAR(255)",
}
_SPARK_BY_CONTENT = {
    "decimal128(12, 2)": "decimal(12, 2)", "numeric(9,1)": "string", "list<element: float>": "double",
    "struct<a: int64>": "bigint", "interval": "bigint", "timestamp[ms]": "timestamp", "unheard-of": "string",
    "object": "string",
}
_ENCODING = """
    CASE WHEN doc_id % 5 = 1 THEN 'utf-8-sig'
         WHEN doc_id % 5 = 3 THEN 'utf-16'
         WHEN doc_id % 5 = 4 THEN 'latin-1'
         WHEN NOT regexp_matches(text, '[^\\x00-\\x7f]') THEN 'ascii'
         WHEN doc_id % 5 = 0 THEN 'utf-8'
         -- Characters outside Latin-1 were written as question marks.
         WHEN NOT regexp_matches(text, '[\\x{80}-\\x{ff}]') THEN 'ascii'
         ELSE 'cp1252' END
"""
_NAME = "regexp_extract(url, '([^/]*)$', 1)"
_STEM = (
    f"CASE WHEN regexp_matches({_NAME}, '^\\.*[^.].*\\.[^.]*$') "
    f"THEN regexp_extract({_NAME}, '^(\\.*[^.].*)\\.[^.]*$', 1) ELSE {_NAME} END"
)
_PAGE = f"(SELECT page_id, {ROUTED_URL} AS u FROM pages)"

ORACLES = {
    "clean_identifier": f"""
        SELECT p_partkey, {_IDENTIFIER.format(x='p_name')} AS from_name,
               {_IDENTIFIER.format(x="(p_partkey || '-' || p_brand)")} AS from_key, 'column_1' AS from_empty
        FROM part""",
    "table_name": f"""
        SELECT page_id, 'ext_' || CASE WHEN c = '' THEN 'external_table' WHEN regexp_matches(c, '^[0-9]') THEN 'tbl_' || c
                                       ELSE c END AS table_name
        FROM (SELECT page_id, regexp_replace({_STEM}, '[^\\p{{L}}\\p{{N}}]', '_', 'g') AS c FROM pages)""",
    "escape_names": """
        SELECT page_id, md5(replace(html, ']', ']]')) AS bracketed, md5(replace(html, '''', '''''')) AS literal FROM pages""",
    "flatten_text": f"SELECT doc_id, length({_FLAT}) AS chars, md5({_FLAT}) AS digest FROM documents",
    "text_prefix": """
        SELECT doc_id, length(cut) AS chars, md5(cut) AS digest
        FROM (SELECT doc_id, CASE WHEN length(text) > 5000 THEN substring(text, 1, 5000) || chr(10) || '... (truncated)'
                                  ELSE text END AS cut FROM documents)""",
    "delimiter_name": """
        SELECT doc_id, ['comma', 'tab', 'pipe', 'semicolon', 'space', ''':''', '''\\r\\n'''][doc_id % 7 + 1] AS name,
               [',', '\\t', '|', ';', ' ', ':', '\\r\\n'][doc_id % 7 + 1] AS shown
        FROM documents""",
    "format_size": """
        SELECT doc_id, CASE WHEN s = 0 THEN '0 B' WHEN s < 1024 THEN printf('%.1f B', s::DOUBLE)
                            WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0::DOUBLE)
                            WHEN s < 1073741824 THEN printf('%.1f MB', s / 1048576.0::DOUBLE)
                            ELSE printf('%.1f GB', s / 1073741824.0::DOUBLE) END AS size
        FROM (SELECT doc_id, n_chars * CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1024 WHEN 3 THEN 65536
                                                       ELSE 1073741824 END AS s FROM documents)""",
    "sample_render": """
        SELECT l_orderkey, l_linenumber,
               'l_orderkey | l_partkey | l_suppkey | l_linenumber | l_quantity | l_extendedprice | l_discount | l_tax'
               || ' | ... (3 more)' AS header,
               concat_ws(' | ', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
                         l_tax) || ' | ...' AS line
        FROM lineitem""",
    "json_path_quote": f"""
        SELECT p_partkey, {_JSON_PATH.format(x='p_type')} AS plain, {_JSON_PATH.format(x='p_name')} AS spaced,
               {_JSON_PATH.format(x="(p_name || chr(34) || p_brand || '''' || chr(92))")} AS odd
        FROM part""",
    "safe_type": """
        SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'INT' WHEN 1 THEN 'NVARCHAR(' || n_chars || ')'
                            WHEN 2 THEN 'decimal ( ' || n_chars || ' , 4 )' WHEN 3 THEN 'varbinary(max)'
                            ELSE 'NVARCHAR(MAX)' END AS sql_type
        FROM documents""",
    "map_types": f"""
        SELECT doc_id, plain AS sql_type,
               CASE WHEN t IN ('object', 'str', 'string') THEN {STRING_TYPE.format(n='n_chars')} ELSE plain END AS sized_type,
               {sql_case('t', {**_SPARK_TYPES, **_SPARK_BY_CONTENT})} AS spark_type
        FROM (SELECT doc_id, n_chars, lower({_TYPE}) AS t,
                     {sql_case(f'lower({_TYPE})', {**_SQL_TYPES, **_BY_CONTENT})} AS plain FROM documents)""",
    "string_sizing": f"""
        SELECT doc_id, sized, {STRING_TYPE.format(n='sized')} AS sql_type
        FROM (SELECT doc_id, CAST(ceil(length(text) * 1.25) AS BIGINT) AS sized FROM documents)""",
    "detect_encoding": f"""
        SELECT doc_id, e AS encoding,
               CASE e WHEN 'utf-8' THEN 99 WHEN 'cp1252' THEN 50 WHEN 'latin-1' THEN 40 ELSE 100 END::BIGINT AS confidence,
               CASE e WHEN 'utf-16' THEN '1200' WHEN 'utf-8' THEN '65001' WHEN 'utf-8-sig' THEN '65001'
                      ELSE '1252' END AS codepage
        FROM (SELECT doc_id, {_ENCODING} AS e FROM documents)""",
    "codepage": f"""
        SELECT doc_id, {sql_list([*lookups.CODEPAGES.values(), 'ACP'])}[doc_id % {len(lookups.CODEPAGES) + 1} + 1]
               AS codepage FROM documents""",
    "supported_types": f"""
        SELECT DISTINCT {sql_list(list(lookups.EXTENSION_TYPES.values()))}[doc_id % {len(lookups.EXTENSION_TYPES)} + 1]
               AS file_type FROM documents""",
    "route_url": f"""
        SELECT page_id, kind,
               CASE kind WHEN 'local' THEN 'local' WHEN 's3' THEN 's3://lake-' || page_id
                         ELSE CASE page_id % 6 WHEN 2 THEN 'azure://box'
                              ELSE 'https://acct' || page_id || '.blob.core.windows.net' END END AS connection,
               CASE WHEN kind = 'local' THEN regexp_extract(u, '([^/]*)$', 1)
                    ELSE regexp_extract(url_decode(replace(rtrim(regexp_extract(u, '^[a-z0-9]+://[^/?#]*([^?#]*)', 1), '/'),
                                                           '+', '%2B')), '([^/]*)$', 1) END AS name
        FROM (SELECT *, CASE page_id % 6 WHEN 1 THEN 's3' WHEN 2 THEN 'azure' WHEN 3 THEN 'azure' ELSE 'local' END AS kind
              FROM {_PAGE})""",
    "parse_object_url": f"""
        SELECT page_id, CASE WHEN error IS NULL THEN container END AS container,
               CASE WHEN error IS NULL THEN object_key END AS object_key, error
        FROM (SELECT page_id,
                     CASE page_id % 6 WHEN 1 THEN 'lake-' || page_id ELSE 'box' END AS container,
                     url_decode(replace(ltrim(CASE WHEN page_id % 6 = 3 THEN regexp_extract(p, '^/[^/]*/(.*)$', 1) ELSE p END,
                                              '/'), '+', '%2B')) AS object_key,
                     CASE WHEN page_id % 6 = 5 THEN 'unsupported scheme'
                          WHEN page_id % 6 = 4 THEN 'not a blob storage host'
                          WHEN page_id % 6 = 0 AND u LIKE 'https%' THEN 'not a blob storage host'
                          WHEN page_id % 6 = 0 THEN 'unsupported scheme' END AS error
              FROM (SELECT *, regexp_extract(u, '^[a-z0-9]+://[^/?#]*([^?#]*)', 1) AS p FROM {_PAGE}))""",
    "storage_parts": """
        SELECT page_id,
               CASE page_id % 6 WHEN 0 THEN 'adls://box@acct.dfs.core.windows.net'
                    WHEN 1 THEN 'abs://box@acct.blob.core.windows.net' WHEN 2 THEN 'abs://box@acct.blob.core.windows.net'
                    WHEN 3 THEN 's3://bucket'
                    ELSE 'adls://<container>@<storage_account>.dfs.core.windows.net' END AS location,
               CASE page_id % 6 WHEN 0 THEN 'raw/' || page_id || '.csv' WHEN 1 THEN 'raw/' || page_id || '.csv'
                    WHEN 2 THEN page_id || '.csv' WHEN 3 THEN 'raw/' || page_id || '.csv'
                    WHEN 4 THEN '<path>/f' || page_id || '.csv' ELSE 'C:/in/' || page_id || '.csv' END AS relative_path,
               CASE page_id % 6 WHEN 0 THEN 'abfss://box@acct.dfs.core.windows.net'
                    WHEN 1 THEN 'wasbs://box@acct.blob.core.windows.net' WHEN 2 THEN 'wasbs://box@acct.blob.core.windows.net'
                    ELSE 'wasbs://<container>@<storage_account>.blob.core.windows.net' END AS location_2019,
               CASE page_id % 6 WHEN 0 THEN 'raw/' || page_id || '.csv' WHEN 1 THEN 'raw/' || page_id || '.csv'
                    WHEN 2 THEN page_id || '.csv' WHEN 3 THEN 's3://bucket/raw/' || page_id || '.csv'
                    WHEN 4 THEN '<path>/f' || page_id || '.csv' ELSE 'C:/in/' || page_id || '.csv' END AS relative_path_2019
        FROM pages""",
}
