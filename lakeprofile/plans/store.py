"""A versioned store of profiles: each run profiles only what has changed since the one before.

    profiles/part=p<id>/   profiles made by one run, never changed afterwards
    entries/<id>/          all entries a run has seen: signature, and the part that holds the profile
    versions/<number>.json what a run has published

A run writes its part and its entries first. They count once the version file stands under its number, which one rename does:
a run that dies, or that loses the race for a number, leaves nothing that readers see. Profiles of unchanged entries are not
read or written again, so a run costs a listing, a join of signatures and the profiles of what is new.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeprofile.operators.listing import changed_files, entry_signatures
from lakeprofile.plans.profile import location_listing, profile_listing
from lakeprofile.session import qualify, rename_once, write_and_read
from lakeprofile.sources.chunks import CHUNK_BYTES

VERSION = "version bigint, location string, entries string, profiled bigint, kept bigint, removed bigint"


class StoreConflict(RuntimeError):
    """Another run has published the version that this one was about to."""


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def history(spark: SparkSession, store: str) -> DataFrame:
    """The versions of a store: number, location, how many entries were profiled, kept and removed."""
    folder = f"{qualify(spark, store)}/versions"
    file_system, path = _file_system(spark, folder)
    if not file_system.exists(path):
        return spark.createDataFrame([], VERSION)
    return spark.read.schema(VERSION).option("pathGlobFilter", "[0-9]*.json").json(folder)


def _version(spark: SparkSession, store: str, version: int | None):
    """The row of a version, or of the latest one; None for a store without any."""
    versions = history(spark, store)
    wanted = versions if version is None else versions.filter(F.col("version") == version)
    return wanted.orderBy(F.desc("version")).first()


def _publish(spark: SparkSession, store: str, version: dict) -> None:
    """Writes the version file under a name of its own and renames it; a number that is taken is a conflict."""
    target = f"{store}/versions/{version['version']:020}.json"
    file_system, draft = _file_system(spark, f"{store}/versions/.draft-{uuid.uuid4().hex}")
    out = file_system.create(draft)
    out.write(bytearray(json.dumps(version).encode()))
    out.close()
    try:
        rename_once(spark, draft.toString(), target)
    except FileExistsError as problem:
        file_system.delete(draft, False)
        raise StoreConflict(target) from problem


def refresh(spark: SparkSession, location: str, store: str, retry_failed: bool = False, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Brings the profiles of a location up to date and returns the number of the version it published.

    An entry is profiled again if it is new, or if its files differ in number, path, time or size from the last run; a table
    folder is one entry. Entries that couldn't be listed are tried again each time, those whose profile failed only with
    ``retry_failed``. Entries that are gone leave the version. ``StoreConflict`` tells that another run was faster.
    """
    location, store = qualify(spark, location), qualify(spark, store)
    before = _version(spark, store, None)
    if before is not None and before.location != location:
        raise ValueError(f"the store holds profiles of {before.location}")
    number = before.version + 1 if before is not None else 0
    run = uuid.uuid4().hex
    listing = write_and_read(location_listing(spark, location), "store-listing")
    current = entry_signatures(listing)
    if before is None:
        known = spark.createDataFrame([], current.schema).withColumns({"part": F.lit(""), "failed": F.lit(False)})
    else:
        known = spark.read.parquet(f"{store}/entries/{before.entries}")
    valid = known.filter(~F.col("failed")) if retry_failed else known
    changed = write_and_read(changed_files(current, valid, "files", "digest"), "store-changed")
    entry = F.coalesce("table_root", "path")
    to_do = listing.join(changed.select(F.col("path").alias("__entry")), entry == F.col("__entry"), "left_semi")
    part = f"{store}/profiles/part=p{run}"
    profiled = 0
    if not changed.isEmpty():
        profile_listing(to_do, chunk_bytes).write.parquet(part)
        profiled = changed.count()
        outcome = spark.read.parquet(part).select("path", F.col("error").isNotNull().alias("failed"))
        fresh = changed.join(outcome, "path", "left").select(
            *changed.columns, F.lit(f"p{run}").alias("part"), F.coalesce("failed", F.lit(True)).alias("failed"))
    else:
        fresh = known.limit(0)
    kept = known.join(current.select("path"), "path", "left_semi").join(changed.select("path"), "path", "left_anti")
    kept.select(*fresh.columns).unionByName(fresh).write.parquet(f"{store}/entries/{run}")
    total = spark.read.parquet(f"{store}/entries/{run}").count()
    gone = known.join(current.select("path"), "path", "left_anti").count()
    _publish(spark, store, {"version": number, "location": location, "entries": run, "profiled": profiled, "kept": total - profiled,
                            "removed": gone})
    return number


def stored_profiles(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The profiles of a version, the latest by default, as ``profile_location`` gave them, with ``part``: the run that made each."""
    store = qualify(spark, store)
    found = _version(spark, store, version)
    if found is None:
        raise ValueError(f"no version {'' if version is None else version} in {store}")
    entries = spark.read.parquet(f"{store}/entries/{found.entries}").select("path", "part")
    # Parts of runs that published nothing find no partner; parts that nothing is left of are not read at all.
    return spark.read.parquet(f"{store}/profiles").join(entries, ["path", "part"])


def stored_changes(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """What a version changed over the one before: ``path`` and ``change`` (added, changed, removed)."""
    store = qualify(spark, store)
    found = _version(spark, store, version)
    if found is None:
        raise ValueError(f"no version {'' if version is None else version} in {store}")
    now = spark.read.parquet(f"{store}/entries/{found.entries}").select("path", F.col("part").alias("now"))
    before = _version(spark, store, found.version - 1) if found.version else None
    if before is None:
        return now.select("path", F.lit("added").alias("change"))
    then = spark.read.parquet(f"{store}/entries/{before.entries}").select("path", F.col("part").alias("then"))
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return now.join(then, "path", "full").filter(~F.col("now").eqNullSafe(F.col("then"))).select("path", change.alias("change"))
