"""Parquet footers of many files: no data pages are read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, functions as F

from lakeprofile.session import spread
from lakeprofile.sources.delimited import COLUMNS
from lakeprofile.sources.storage import Storage

FOOTER = (
    "path string, row_count bigint, column_count bigint, compression string, num_row_groups bigint, "
    "created_by string, format_version string, serialized_size bigint, key_value_metadata map<string,string>, "
    "fields array<struct<name:string,type:string,nullable:boolean>>, error string"
)


def _text_pairs(metadata: dict | None) -> dict[str, str]:
    pairs = {}
    for key, value in (metadata or {}).items():
        try:
            pairs[key.decode()] = value.decode()
        except UnicodeDecodeError:
            continue
    return pairs


def _read_footer(storage: Storage, path: str) -> tuple:
    with storage.open(path) as handle:
        parquet = pq.ParquetFile(handle)
        footer, schema = parquet.metadata, parquet.schema_arrow
    compression = None
    if footer.num_row_groups and footer.num_columns:
        compression = footer.row_group(0).column(0).compression
    fields = [{"name": field.name, "type": str(field.type), "nullable": field.nullable} for field in schema]
    return (path, footer.num_rows, len(schema), compression, footer.num_row_groups, footer.created_by,
            str(footer.format_version), footer.serialized_size, _text_pairs(footer.metadata), fields, None)


def read_footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [field.strip().split()[0] for field in FOOTER.split(", ")]
    numbers = {name: "Int64" for name in ("row_count", "column_count", "num_row_groups", "serialized_size")}
    storage = Storage()
    for batch in batches:
        rows = []
        for path in batch["path"]:
            try:
                rows.append(_read_footer(storage, path))
            except Exception as problem:
                rows.append((path, *[None] * (len(names) - 2), str(problem)))
        yield pd.DataFrame(rows, columns=names).astype(numbers)


def footers(files: DataFrame) -> DataFrame:
    """One row per Parquet file in column ``path``."""
    return spread(files.select("path"), "path").mapInPandas(read_footers, FOOTER)


def footer_columns(fields: Column) -> Column:
    """Column profiles from footer fields: types and nullability are declared, nothing is sampled."""
    return F.transform(
        fields,
        lambda field, position: F.struct(
            (position + 1).alias("ordinal"), field["name"].alias("name"), field["type"].alias("detected_type"),
            F.lit(None).cast("string").alias("spark_type"), field["nullable"].alias("nullable"),
            F.lit(None).cast("string").alias("nesting"), F.lit(None).cast("bigint").alias("observed_max_len"),
            F.lit(None).cast("bigint").alias("sized_len"), F.lit(None).cast("string").alias("sample_value"),
        ),
    ).cast(COLUMNS)


def first_file_order(path: Column, root: Column) -> Column:
    """Sort key of a walk that takes the files of a folder before its subfolders, each in name order.

    The file part gets a prefix that sorts before any folder part of the same level.
    """
    parts = F.split(F.substr(path, F.length(root) + 2), "/")
    folders = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda part: F.concat(F.lit("1"), part))
    return F.concat(folders, F.array(F.concat(F.lit("0"), F.element_at(parts, -1))))
