"""Leading bytes of many files, and what they say about type and encoding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lakeprofile.functions.encodings import detect_encoding
from lakeprofile.lookups import ENCODING_SAMPLE_BYTES
from lakeprofile.session import spread
from lakeprofile.sources.delimited import delimited_lines
from lakeprofile.sources.storage import Storage

HEAD = "path string, size bigint, file_type string, head binary, looks_delimited boolean, head_error string"
FILES_PER_BATCH = 64


def looks_delimited(head: bytes) -> bool:
    """True where the leading lines split alike at one delimiter, below what looks like a header."""
    try:
        text = head.decode("utf-8", "strict" if len(head) < ENCODING_SAMPLE_BYTES else "ignore")
    except UnicodeDecodeError:
        return False
    return delimited_lines(text)


def file_heads(files: DataFrame, limit: int = ENCODING_SAMPLE_BYTES) -> DataFrame:
    """Leading bytes per file; only files without a known type are tested for a header row."""
    names = [field.split()[0] for field in HEAD.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        storage = Storage()
        rows = []
        for batch in batches:
            for path, size, file_type in batch[["path", "size", "file_type"]].itertuples(index=False):
                try:
                    head = storage.read_head(path, limit)
                    rows.append((path, size, file_type, head,
                                 looks_delimited(head) if file_type is None else None, None))
                except Exception as problem:
                    rows.append((path, size, file_type, None, None, str(problem)))
                if len(rows) == FILES_PER_BATCH:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return spread(files.select("path", "size", "file_type"), "path").mapInPandas(read, HEAD)


def first_character(head: Column, encoding: Column) -> Column:
    """First character that is not blank, from the leading bytes."""
    text = F.when(encoding.startswith("utf-16"), F.decode(head, "UTF-16")).otherwise(F.decode(head, "ISO-8859-1"))
    return F.regexp_extract(text, "^(?:\\x{FEFF}|\\xEF\\xBB\\xBF|[ \\t\\r\\n])*([^ \\t\\r\\n])", 1)


def type_by_content(head: Column, delimited: Column) -> Column:
    """Type of a file from its first bytes: Parquet mark, JSON bracket, header row, else text."""
    first = F.regexp_extract(F.decode(head, "ISO-8859-1"), "^[\\s]*(\\S)", 1)
    readable = F.is_valid_utf8(head.substr(F.lit(1), F.lit(1)))
    return (
        F.when(F.hex(head.substr(F.lit(1), F.lit(4))) == "50415231", "parquet")
        .when(readable & first.isin("{", "["), "json")
        .when(delimited, "csv")
        .otherwise("text")
    )


def sniffed(files: DataFrame) -> DataFrame:
    """Type, encoding and first character of each file from its leading bytes, which go no further than this.

    Files come with ``path, size, file_type`` (null where the name says nothing).
    """
    heads = file_heads(files)
    content_type = F.when(F.col("head_error").isNull(), type_by_content(F.col("head"), F.col("looks_delimited")))
    told = heads.withColumn("sniffed_type", F.coalesce("file_type", content_type, F.lit("unknown"))).withColumn(
        "found", detect_encoding(F.col("head"), F.col("size") <= F.octet_length("head"))
    )
    return told.select(
        "path", "sniffed_type", F.col("found.encoding").alias("encoding"),
        F.col("found.confidence").alias("encoding_confidence"),
        first_character(F.col("head"), F.col("found.encoding")).alias("first_char"), "head_error",
    )
