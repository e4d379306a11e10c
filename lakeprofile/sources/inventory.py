"""Listing of folders and object-store prefixes, with table folders collapsed to one entry."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeprofile.functions.paths import base_name, parent_path, path_suffix
from lakeprofile.functions.urls import storage_kind
from lakeprofile.session import qualify, spread, write_and_read
from lakeprofile.sources.storage import Storage, join_path

LISTING = (
    "root string, path string, kind string, size bigint, modified timestamp, "
    "table_root string, table_type string, error string"
)
# Folders one task walks below each folder it was given before it hands the rest back.
FOLDERS_PER_TASK_ROW = 256


def _table_type(storage: Storage, folder: str) -> str | None:
    if storage.is_folder(join_path(folder, "_delta_log")):
        return "delta"
    metadata = join_path(folder, "metadata")
    if storage.is_folder(metadata):
        for name, is_folder, _, _ in storage.children(metadata):
            if not is_folder and name.lower().endswith(".metadata.json"):
                return "iceberg"
    return None


def _walk(storage: Storage, root: str, path: str, table_root: str | None, table_type: str | None,
          prune_hidden: bool, depth: int | None) -> Iterator[tuple]:
    """Entries below one path. Folders over the budget come back with kind ``pending``."""

    def entry(where, kind, size=None, modified=None, owner=(None, None), error=None):
        return root, where, kind, size, modified, owner[0], owner[1], error

    try:
        start = storage.info(path)
    except Exception as problem:  # an unreachable store is a row, not a failed job
        yield entry(path, "error", error=str(problem))
        return
    if start.type == FileType.NotFound:
        yield entry(path, "error", error=f"path does not exist: {path}")
        return
    if start.type == FileType.File:
        yield entry(path, "file", start.size, start.mtime_ns / 1e9, (table_root, table_type))
        return

    queue = deque([(path, (table_root, table_type), 0)])
    walked = 0
    while queue:
        folder, owner, level = queue.popleft()
        if walked >= FOLDERS_PER_TASK_ROW:
            yield entry(folder, "pending", owner=owner)
            continue
        walked += 1
        try:
            if owner[0] is None:
                found = _table_type(storage, folder)
                if found is not None:
                    owner = (folder, found)
                    yield entry(folder, "table", owner=owner)
                elif depth is not None and level >= depth:
                    yield entry(folder, "folder")
                    continue
            for name, is_folder, size, modified in storage.children(folder):
                where = join_path(folder, name)
                if not is_folder:
                    yield entry(where, "file", size, modified, owner)
                elif not (prune_hidden and owner[0] is None and (name.startswith(".") or name == "__pycache__")):
                    queue.append((where, owner, level + 1))
        except Exception as problem:
            yield entry(folder, "error", error=str(problem))


def _lister(prune_hidden: bool, depth: int | None):
    columns = [field.split()[0] for field in LISTING.split(", ")]

    def list_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        storage = Storage()
        rows = []
        for batch in batches:
            for root, path, owner, owner_type in batch[["root", "path", "table_root", "table_type"]].itertuples(
                index=False
            ):
                for row in _walk(storage, root, path, owner or None, owner_type or None, prune_hidden, depth):
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield _listing_frame(rows, columns)
                        rows = []
        if rows:
            yield _listing_frame(rows, columns)

    return list_batches


def _listing_frame(rows: list, columns: list) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    frame["size"] = frame["size"].astype("Int64")
    frame["modified"] = pd.to_datetime(frame["modified"], unit="s").dt.floor("us")
    return frame


def list_paths(paths: DataFrame, prune_hidden: bool = False, depth: int | None = None) -> DataFrame:
    """Every file below the paths in column ``path``, files inside table folders included and tagged.

    Rounds of tasks walk the tree: each task walks its folders up to a budget and hands the rest back, so a
    wide tree fans out over the cluster. Each round is written to shared scratch space before the next.
    """
    spark = paths.sparkSession
    columns = ["root", "path", "table_root", "table_type"]
    frontier = paths.select(F.col("path").alias("root"), "path", F.lit(None).cast("string").alias("table_root"),
                            F.lit(None).cast("string").alias("table_type"))
    rounds = []
    while True:
        listed = write_and_read(frontier.mapInPandas(_lister(prune_hidden, depth), LISTING), "listing")
        rounds.append(listed.filter("kind <> 'pending'"))
        pending = listed.filter("kind = 'pending'").select(*columns)
        if pending.isEmpty():
            break
        frontier = spread(pending, "path")
    listing = rounds[0]
    for more in rounds[1:]:
        listing = listing.unionByName(more)
    return listing


def list_location(spark: SparkSession, location: str, prune_hidden: bool = False,
                  depth: int | None = None) -> DataFrame:
    """``list_paths`` for one location."""
    return list_paths(spark.createDataFrame([(qualify(spark, location),)], "path string"), prune_hidden, depth)


def collapse_tables(listing: DataFrame) -> DataFrame:
    """One row per loose file and one per table folder, whose size is that of all files in it."""
    loose = listing.filter(F.col("table_root").isNull()).select(
        "root", "path", "kind", "size", "modified", F.lit(None).cast("string").alias("table_type"), "error"
    )
    tables = (
        listing.filter(F.col("table_root").isNotNull())
        .groupBy("root", "table_root", "table_type")
        .agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.max("modified").alias("modified"))
        .select("root", F.col("table_root").alias("path"), F.lit("table").alias("kind"), "size", "modified",
                "table_type", F.lit(None).cast("string").alias("error"))
    )
    return loose.unionByName(tables)


def describe_entries(entries: DataFrame) -> DataFrame:
    """Inventory columns derived from the path: names, storage kind, extension."""
    return entries.select(
        "root",
        "path",
        base_name("path").alias("name"),
        parent_path("path").alias("parent"),
        storage_kind("path").alias("scheme"),
        F.when(F.col("kind") == "file", path_suffix(base_name("path"))).alias("extension"),
        (F.col("kind") == "table").alias("is_table_root"),
        "kind",
        "table_type",
        "size",
        "modified",
        "error",
    )


def inventory(spark: SparkSession, location: str, prune_hidden: bool = False) -> DataFrame:
    """The entries of a location: loose files and table folders."""
    return describe_entries(collapse_tables(list_location(spark, location, prune_hidden)))


def inventory_of_paths(paths: DataFrame) -> DataFrame:
    """Entries for an explicit list of paths (column ``path``)."""
    return describe_entries(collapse_tables(list_paths(spread(paths, "path"))))


def list_level(spark: SparkSession, folder: str) -> DataFrame:
    """One directory level: folders, table folders with their size, files."""
    return describe_entries(collapse_tables(list_location(spark, folder, depth=1)))
