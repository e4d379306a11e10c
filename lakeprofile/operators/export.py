"""Reports and data written out as files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import LocalFileSystem
from pyspark.sql import DataFrame, Window, functions as F

from lakeprofile.functions.jsonfn import json_brackets
from lakeprofile.functions.names import one_line
from lakeprofile.session import qualify, rename_once, spread
from lakeprofile.sources.inventory import list_location
from lakeprofile.sources.storage import Storage

_COPY_BYTES = 8 * 1024 * 1024


def export_json(profiles: DataFrame, path: str) -> None:
    """Report as JSON, one document per file entry, missing fields written as null."""
    profiles.write.option("ignoreNullFields", "false").json(path)


def sql_blocks(defined: DataFrame) -> DataFrame:
    """Report as SQL text, one block per file (``path, block``); failures become comments."""
    block = F.concat(
        F.lit("-- File: "), one_line("path"), F.lit("\n-- Type: "), one_line("file_type"), F.lit("\n"),
        F.when(F.col("error").isNotNull(), F.concat(F.lit("-- Error: "), one_line("error"))).otherwise(
            F.coalesce("external_table", F.lit(""))
        ),
        F.lit("\n"),
    )
    return defined.select("path", block.alias("block"))


def export_sql(defined: DataFrame, path: str) -> None:
    """Writes the SQL blocks in path order: sorted parts, one after the other, make the script."""
    sql_blocks(defined).orderBy("path").select("block").write.option("lineSep", "\n").text(path)


def partitioned_write(df: DataFrame, path: str, *partition_by: str, sort_by: str | None = None,
                      max_rows_per_file: int = 5_000_000) -> None:
    """Partitioned Parquet with as many files per value as its rows fill.

    A first pass over the partition columns counts the rows of each value; each value is then dealt to so many tasks, so that
    one that holds a third of the data writes in parallel at any size, and a small one writes one file.
    """
    keys = [F.col(f"`{name}`") for name in partition_by]
    # Values of more than one file: no more than there are files to write, so that Spark may broadcast them safely.
    large = df.groupBy(*[key.alias(f"__{name}") for key, name in zip(keys, partition_by)]).agg(
        F.ceil(F.count("*") / max_rows_per_file).alias("__files")).filter("__files > 1")
    same = [key.eqNullSafe(F.col(f"`__{name}`")) for key, name in zip(keys, partition_by)]
    # The salt follows a row's place and not its content: equal rows spread, and columns of any type do.
    salt = F.when(F.col("__files") > 1, F.pmod(F.hash(F.monotonically_increasing_id()), F.col("__files"))).otherwise(0)
    dealt = df.join(F.broadcast(large), same, "left").withColumn("__salt", salt)
    dealt = dealt.repartition(*keys, "__salt").select(*[F.col(f"`{name}`") for name in df.columns])
    if sort_by is not None:
        dealt = dealt.sortWithinPartitions(*partition_by, sort_by)
    dealt.write.option("maxRecordsPerFile", max_rows_per_file).partitionBy(*partition_by).parquet(path)


def write_at(path: str, offset: int, data: bytes) -> None:
    """Puts bytes into their place of a file that others may be writing too."""
    handle = os.open(path, os.O_CREAT | os.O_WRONLY, 0o644)
    try:
        view = memoryview(data)
        while view:
            done = os.pwrite(handle, view, offset)
            view, offset = view[done:], offset + done
    finally:
        os.close(handle)


def export_document(df: DataFrame, path: str, *order_by: str, root: str | None = None, include_nulls: bool = False) -> int:
    """Writes a table as one JSON document, an array of its rows (below ``root``), and returns its size in bytes.

    Sorted parts are written first. The sizes before a part add up to its place in the document, into which the parts are then
    copied, each by its own task, a few megabytes at a time: no task holds more, and one that runs again writes the same bytes in
    the same place. The document gets its name by a rename at the end; a name that is taken is refused. Null fields are left
    out unless ``include_nulls``; an empty table is an empty array. ``path`` must be on a disk that all executors share: object
    stores and HDFS don't write at a position, there the ordered fragments of ``json_rows`` make the document.
    """
    spark = df.sparkSession
    path = qualify(spark, path)
    file_system, inner = Storage().locate(path)
    if not isinstance(file_system, LocalFileSystem):
        raise ValueError(f"one document can't be written in parts at {path}")
    if os.path.exists(inner):
        raise FileExistsError(path)
    draft = f"{inner}.draft-{uuid.uuid4().hex}"
    opening, closing = (text.encode() for text in json_brackets(root))
    body = F.to_json(F.struct(*[F.col(f"`{name}`") for name in df.columns]), {"ignoreNullFields": "false" if include_nulls else "true"})
    rows = df.orderBy(*order_by) if order_by else df
    rows.select(F.concat(F.lit(","), body).alias("value")).write.option("lineSep", "\n").option("compression", "none").text(f"{draft}/parts")
    # One row per part, that is per task that has written.
    number = F.regexp_extract("path", "/part-(\\d+)[^/]*$", 1).cast("long")
    parts = list_location(spark, f"{draft}/parts").filter("path rlike '/part-[^/]*$' and size > 0").select("path", "size", number.alias("number"))
    before = Window.orderBy("number", "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    # The comma before the first row gives its place to the bracket.
    base, whole = len(opening) - 1, f"{draft}/document"

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        storage = Storage()
        for batch in batches:
            for part, offset in batch[["path", "offset"]].itertuples(index=False):
                at = base + offset
                with storage.open(part) as source:
                    while data := source.read(_COPY_BYTES):
                        write_at(whole, at, data)
                        at += len(data)
                yield pd.DataFrame({"size": [at - base - offset]})

    size = spread(placed, "path").mapInPandas(copy, "size bigint").agg(F.sum("size")).first()[0] or 0
    write_at(whole, 0, opening)
    write_at(whole, base + size if size else len(opening), closing)
    written = os.path.getsize(whole)
    rename_once(spark, whole, inner)
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(draft)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    return written
