"""Names, codes and limits that results must agree on."""

# File extension -> file type (fixed values).
EXTENSION_TYPES = {
    ".txt": "text",
    ".csv": "csv",
    ".tsv": "csv",
    ".parquet": "parquet",
    ".snappy": "parquet",
    ".json": "json",
    ".jsonl": "json",
    ".ndjson": "json",
    ".orc": "orc",
    ".rc": "rc",
    ".delta": "delta",
    ".xlsx": "excel",
    ".xls": "excel",
}

# Encoding name -> code page (fixed values); anything else is ACP.
CODEPAGES = {
    "utf-8": "65001",
    "utf-8-sig": "65001",
    "ascii": "1252",
    "latin-1": "1252",
    "iso-8859-1": "1252",
    "cp1252": "1252",
    "windows-1252": "1252",
    "utf-16": "1200",
    "utf-16-le": "1200",
    "utf-16-be": "1201",
    "shift_jis": "932",
    "euc-jp": "20932",
    "gbk": "936",
    "big5": "950",
}
DEFAULT_CODEPAGE = "ACP"

# Detected type -> SQL type, then Spark type (fixed values). Order matters: an unknown type takes the first
# entry whose name it contains.
TYPES = [
    ("int64", "BIGINT", "bigint"),
    ("int32", "INT", "int"),
    ("int16", "SMALLINT", "smallint"),
    ("int8", "TINYINT", "tinyint"),
    ("int", "INT", "bigint"),
    ("uint64", "DECIMAL(20,0)", "decimal(20,0)"),
    ("uint32", "BIGINT", "bigint"),
    ("uint16", "INT", "int"),
    ("uint8", "SMALLINT", "smallint"),
    ("float64", "FLOAT", "double"),
    ("float32", "REAL", "float"),
    ("float", "FLOAT", "double"),
    ("double", "FLOAT", "double"),
    ("bool", "BIT", "boolean"),
    ("boolean", "BIT", "boolean"),
    ("object", "NVARCHAR(255)", "string"),
    ("str", "NVARCHAR(255)", "string"),
    ("string", "NVARCHAR(255)", "string"),
    ("large_string", "NVARCHAR(MAX)", "string"),
    ("datetime64[ns]", "DATETIME2(7)", "timestamp"),
    ("datetime64[us]", "DATETIME2(6)", "timestamp"),
    ("timestamp[us]", "DATETIME2(6)", "timestamp"),
    ("timestamp[ns]", "DATETIME2(7)", "timestamp"),
    ("timestamp", "DATETIME2(7)", "timestamp"),
    ("date32", "DATE", "date"),
    ("date", "DATE", "date"),
    ("time", "TIME(7)", "string"),
    ("time64[us]", "TIME(6)", "string"),
    ("decimal128", "DECIMAL(38,10)", "decimal(38,10)"),
    ("binary", "VARBINARY(MAX)", "binary"),
    ("large_binary", "VARBINARY(MAX)", "binary"),
    ("list", "NVARCHAR(MAX)", "string"),
    ("struct", "NVARCHAR(MAX)", "string"),
    ("dict", "NVARCHAR(MAX)", "string"),
    ("map", "NVARCHAR(MAX)", "string"),
]
DEFAULT_STRING = "NVARCHAR(255)"
LONG_STRING = "NVARCHAR(MAX)"
DEFAULT_DECIMAL = "DECIMAL(18,4)"

# Iceberg primitive type -> detected type (fixed values); anything else is str.
ICEBERG_TYPES = {
    "boolean": "bool",
    "int": "int32",
    "long": "int64",
    "float": "float32",
    "double": "float64",
    "string": "str",
    "date": "date",
    "time": "time",
    "timestamp": "timestamp",
    "timestamptz": "timestamp",
    "timestamp_ntz": "timestamp",
    "binary": "binary",
    "uuid": "str",
    "fixed": "binary",
    "decimal": "decimal128",
}

# Delimiter -> name (fixed values).
DELIMITER_NAMES = {",": "comma", "\t": "tab", "|": "pipe", ";": "semicolon", " ": "space"}

# Compression codec -> codec class (fixed values).
CODEC_CLASSES = {
    "SNAPPY": "org.apache.hadoop.io.compress.SnappyCodec",
    "GZIP": "org.apache.hadoop.io.compress.GzipCodec",
    "GZ": "org.apache.hadoop.io.compress.GzipCodec",
    "DEFAULT": "org.apache.hadoop.io.compress.DefaultCodec",
}
RC_SERDE = "org.apache.hadoop.hive.serde2.columnar.ColumnarSerDe"

# File type -> external format name (fixed values); anything else is DELIMITEDTEXT.
EXTERNAL_FORMATS = {
    "csv": "DELIMITEDTEXT",
    "json": "JSON",
    "parquet": "PARQUET",
    "delta": "DELTA",
    "orc": "ORC",
    "rc": "RCFILE",
}

# File type -> OPENROWSET format keyword (fixed values); anything else is CSV.
FORMAT_KEYWORDS = {"parquet": "PARQUET", "delta": "DELTA", "json": "CSV", "orc": "ORC"}

# Target platforms (fixed values).
PLATFORMS = [
    "sql_server_2019",
    "sql_server_2022",
    "sql_server_2025",
    "azure_sql_db",
    "azure_sql_mi",
    "fabric_sql_db",
]

# Load method -> rank and description (fixed values).
LOAD_METHODS = {
    "bulk_insert": (1, "BULK INSERT (high-speed batch loads)"),
    "openrowset": (2, "OPENROWSET (ad-hoc / exploratory queries)"),
    "external_table": (3, "CREATE EXTERNAL TABLE (persistent virtual table)"),
    "openjson": (4, "OPENJSON / JSON_VALUE (native JSON parsing)"),
    "for_json": (5, "FOR JSON PATH (export to JSON)"),
}

# Profile encoding -> Java charset (fixed values). ASCII is read as UTF-8: later bytes may be more.
READER_CHARSETS = {"ascii": "UTF-8", "utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1", "cp1252": "windows-1252"}

# Limits (fixed values).
DIALECT_SAMPLE_CHARS = 4096
CSV_SAMPLE_ROWS = 1000
WORKBOOK_SAMPLE_ROWS = 200
ENCODING_SAMPLE_BYTES = 65536
PREVIEW_MAX_ROWS = 10000

# Platforms on which each load method works (fixed values).
BULK_INSERT_PLATFORMS = ["sql_server_2019", "sql_server_2022", "sql_server_2025", "azure_sql_db", "azure_sql_mi"]
EXTERNAL_TABLE_PLATFORMS = ["sql_server_2019", "sql_server_2022", "sql_server_2025"]
# External format -> platforms that can define it (fixed values).
EXTERNAL_FORMAT_PLATFORMS = {
    "DELIMITEDTEXT": PLATFORMS,
    "PARQUET": ["sql_server_2022", "sql_server_2025", "azure_sql_db", "azure_sql_mi", "fabric_sql_db"],
    "DELTA": ["sql_server_2022", "sql_server_2025"],
    "ORC": ["sql_server_2019"],
    "RCFILE": ["sql_server_2019"],
    "JSON": [],
}
# Columnar type -> platforms whose OPENROWSET reads it (fixed values); other types read everywhere.
OPENROWSET_PLATFORMS = {
    "parquet": ["sql_server_2022", "sql_server_2025", "azure_sql_db", "azure_sql_mi", "fabric_sql_db"],
    "delta": ["sql_server_2022", "sql_server_2025"],
}
# File types a profile can report.
FILE_TYPES = ["csv", "delta", "excel", "iceberg", "json", "orc", "parquet", "rc", "text", "unknown"]

# Recommended paths: (best option, fastest path, lowest cost) (fixed values).
ADVICE_DEFAULT = (
    "CREATE TABLE + INSERT validation flow",
    "OPENROWSET for preview / exploratory access",
    "OPENROWSET with projection/filtering",
)
ADVICE_FABRIC = (
    "OPENROWSET with SELECT INTO / INSERT INTO ... SELECT",
    "OPENROWSET for direct external access",
    "OPENROWSET over parquet with projected columns",
)
ADVICE_TEXT = ("BULK INSERT for load, then validate in SQL", "BULK INSERT for local or staged CSV/text files")
ADVICE_JSON = (
    "Load JSON as text with OPENROWSET(SINGLE_CLOB), then parse with OPENJSON",
    "OPENJSON after loading the file as NVARCHAR(MAX)",
)
ADVICE_CONVERT = ("%s is not supported; convert to CSV before loading", "Convert to CSV, then use BULK INSERT")
ADVICE_COLUMNAR = ("OPENROWSET FORMAT='%s' over ABS, ADLS, or S3 storage", "OPENROWSET with projected columns")
STAGING_DEFAULT = "Load to a staging table first, then transform into the final schema"
STAGING_LARGE = "For large files, land data in staging and validate in batches"
STAGING_SMALL = "For small files, direct load is fine, but keep a validation query ready"
