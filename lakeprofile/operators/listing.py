"""Operators on listings and profiles as tables: roots, sizes, changes, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakeprofile.functions.paths import ancestors, parent_path

SALTS = 16


def table_roots(listing: DataFrame) -> DataFrame:
    """Folders that look like tables in a flat listing (``path`` only), with their type; Delta wins over Iceberg."""
    delta = F.regexp_extract("path", "^(.*)/_delta_log/[^/]*$", 1)
    iceberg = F.regexp_extract("path", "(?i)^(.*)/metadata/[^/]*\\.metadata\\.json$", 1)
    found = listing.select(
        F.coalesce(F.nullif(delta, F.lit("")), F.nullif(iceberg, F.lit(""))).alias("table_root"),
        (delta != "").alias("is_delta"),
    )
    return found.filter("table_root IS NOT NULL").groupBy("table_root").agg(
        F.when(F.bool_or("is_delta"), "delta").otherwise("iceberg").alias("table_type")
    )


def _with_ancestor(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """Paths that lie below one of the folders (column ``table_root``), with that folder's columns.

    An equi-join on ancestor folders. The top folders are ancestors of everything, so the path side is salted and the
    (few) folders are copied once per salt; Spark broadcasts them where they are small.
    """
    copies = folders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    above = rows.select(
        "path", F.explode(ancestors("path")).alias("table_root"),
        F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    return above.join(copies, ["table_root", "salt"]).drop("salt")


def outermost_roots(listing: DataFrame) -> DataFrame:
    """Table folders that lie in no other table folder: a path is below one of them at most."""
    roots = table_roots(listing)
    nested = _with_ancestor(roots.select(F.col("table_root").alias("path")), roots.select("table_root"))
    return roots.join(nested.select(F.col("path").alias("table_root")), "table_root", "left_anti")


def tag_table_files(listing: DataFrame) -> DataFrame:
    """Listing plus ``table_root`` and ``table_type`` of the outermost table folder above each file."""
    owners = _with_ancestor(listing, outermost_roots(listing))
    return listing.join(owners, "path", "left")


def collapse_listing(tagged: DataFrame) -> DataFrame:
    """One row per loose file and per table folder (``path, entry_type, files, size``)."""
    entry = F.coalesce("table_root", "path")
    # The first grouping is on the entry alone; partial sums collapse a huge table within each task.
    return tagged.groupBy(entry.alias("path"), F.coalesce("table_type", F.lit("file")).alias("entry_type")).agg(
        F.count("*").alias("files"), F.sum("size").alias("size")
    )


def folder_sizes(listing: DataFrame, include_hidden: bool = True) -> DataFrame:
    """Files and bytes per folder, everything below it included.

    Sizes are summed per parent first, so the top folders receive one row per folder below them and task, not per file.
    """
    files = listing if include_hidden else listing.filter(~F.col("path").rlike("/\\.[^/]*$"))
    direct = files.groupBy(parent_path("path").alias("parent")).agg(F.count("*").alias("files"), F.sum("size").alias("size"))
    inside = direct.select(F.explode(F.array_append(ancestors("parent"), F.col("parent"))).alias("folder"), "files", "size")
    return inside.filter("folder <> ''").groupBy("folder").agg(F.sum("files").alias("files"), F.sum("size").alias("size"))


def prune_hidden(listing: DataFrame) -> DataFrame:
    """Without files below dot folders and ``__pycache__``; dot files themselves stay."""
    return listing.filter(~F.col("path").rlike("/\\.[^/]+/") & ~F.col("path").contains("/__pycache__/"))


def changed_files(current: DataFrame, known: DataFrame, *more: str) -> DataFrame:
    """Entries whose path, time or size, or one of ``more`` columns, differs from the last profile: what has to be profiled again."""
    keys = ["path", "modified", "size", *more]
    return current.join(known.select(*keys), keys, "left_anti").select(*current.columns)


def upsert_profiles(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Profiles with new ones in place of old ones of the same path; fields either side lacks become null."""
    return known.join(fresh.select("path"), "path", "left_anti").unionByName(fresh, allowMissingColumns=True)


def table_signatures(listing: DataFrame) -> DataFrame:
    """Path, time and size per entry. A table folder folds in the files of its log and metadata folders."""
    loose = listing.filter(F.col("table_root").isNull() & (F.col("kind") == "file")).select("path", "modified", "size")
    in_log = F.substr("path", F.length("table_root") + 1).rlike("^/(_delta_log|metadata)/[^/]+$")
    tables = (
        listing.filter(F.col("table_root").isNotNull())
        .groupBy(F.col("table_root").alias("path"))
        .agg(F.max(F.when(in_log | (F.col("kind") == "table"), F.col("modified"))).alias("modified"),
             F.coalesce(F.sum(F.when(in_log, F.col("size"))), F.lit(0)).alias("size"))
    )
    return loose.unionByName(tables)


def entry_signatures(listing: DataFrame) -> DataFrame:
    """``path, modified, size, files, digest`` per entry: a loose file, or a table folder with all files below it.

    The digest covers path, time and size of every file in any order, so that files that take each other's place are seen.
    """
    own = F.xxhash64("path", "modified", "size")
    return listing.groupBy(F.coalesce("table_root", "path").alias("path")).agg(
        F.max("modified").alias("modified"), F.sum("size").alias("size"), F.count("*").alias("files"), F.bit_xor(own).alias("digest"))
