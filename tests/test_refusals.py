"""Logs that can't be replayed, links that lead back up, and other cases that must not pass for something else."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakeprofile.functions import jsonfn, urls
from lakeprofile.operators import export, listing
from lakeprofile.plans import profile as plan
from lakeprofile.plans.preview import preview
from lakeprofile.session import clear_scratch, scratch_path, spread, write_and_read
from lakeprofile.sources import tables
from lakeprofile.sources.delimited import delimited_lines, dialect_of
from lakeprofile.sources.inventory import list_location

META = {"metaData": {"id": "t", "schemaString": '{"type":"struct","fields":[{"name":"n","type":"long","nullable":true,"metadata":{}}]}',
                     "partitionColumns": [], "configuration": {}}}


def delta(root, commits, broken=None):
    """A Delta folder with one data file per commit; ``broken`` maps a version to other text."""
    os.makedirs(root / "_delta_log")
    for version in commits:
        pq.write_table(pa.table({"n": [version]}), root / f"f{version}.parquet")
        actions = [{"add": {"path": f"f{version}.parquet", "stats": '{"numRecords":1}'}}] + ([META] if version == commits[0] else [])
        text = "\n".join(map(json.dumps, actions)) + "\n"
        (root / "_delta_log" / f"{version:020d}.json").write_text((broken or {}).get(version, text))
    return str(root)


def files_of_table(spark, root):
    return list_location(spark, root).filter("kind = 'file'")


def read(spark, root):
    return sorted(row.n for row in tables.read_delta(spark, root, files_of_table(spark, root)).collect())


def test_a_whole_log(spark, tmp_path):
    root = delta(tmp_path / "t", [0, 1, 2])
    assert read(spark, root) == [0, 1, 2]
    assert plan.profile_location(spark, root).first().row_count == 3


@pytest.mark.parametrize("case", ["gap", "cut line", "late start"])
def test_a_log_that_is_not_whole(spark, tmp_path, case):
    root = {
        "gap": lambda: delta(tmp_path / "t", [0, 2]),
        "cut line": lambda: delta(tmp_path / "t", [0, 1], {1: '{"add":{"path":"f1.parq'}),
        "late start": lambda: delta(tmp_path / "t", [3, 4]),
    }[case]()
    with pytest.raises(ValueError, match="can't be replayed"):
        read(spark, root)
    row = plan.profile_location(spark, root).first()
    assert row.row_count is None and row.warning and row.schema_inference == "underlying_parquet_file"


def test_a_deletion_vector_that_cant_be_read_fails_the_read(spark, tmp_path):
    vector = {"storageType": "i", "pathOrInlineDv": "00000", "sizeInBytes": 4, "cardinality": 1}
    action = {"add": {"path": "f1.parquet", "stats": '{"numRecords":2}', "deletionVector": vector}}
    root = delta(tmp_path / "t", [0, 1], {1: json.dumps(action) + "\n"})
    with pytest.raises(Exception, match="deletion vector"):
        read(spark, root)
    with pytest.raises(Exception, match="deletion vector"):
        preview(spark, root).collect()


def test_incomplete_and_broken_checkpoints_fail_no_other_table(spark, tmp_path):
    whole = delta(tmp_path / "lake" / "whole", [0, 1])
    half = tmp_path / "lake" / "half"
    delta(half, [0, 1])
    (half / "_delta_log" / "00000000000000000001.checkpoint.0000000001.0000000002.parquet").write_bytes(b"x")
    bad = tmp_path / "lake" / "bad"
    delta(bad, [0, 1])
    (bad / "_delta_log" / "00000000000000000001.checkpoint.parquet").write_bytes(b"no parquet")
    (tmp_path / "lake" / "a.csv").write_text("a,b\n1,2\n")
    found = {row.name: row for row in plan.profile_location(spark, str(tmp_path / "lake")).collect()}
    assert (found["whole"].row_count, found["half"].row_count, found["bad"].row_count) == (2, 2, None)
    assert found["bad"].warning and found["a.csv"].row_count == 1 and read(spark, whole) == [0, 1]


def test_links_to_folders_are_not_followed(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n")
    os.symlink(tmp_path, tmp_path / "up")
    assert [row.name for row in list_location(spark, str(tmp_path)).filter("kind = 'file'").select(
        F.element_at(F.split("path", "/"), -1).alias("name")).collect()] == ["a.txt"]


def test_schemes_of_readers_are_remote(spark):
    rows = [("s3a://b/k%20x", "s3"), ("abfss://c@a.dfs.core.windows.net/k", "azure"), ("wasbs://c@a/k", "azure"), ("/data/k", "local")]
    got = spark.createDataFrame(rows, "url string, kind string").select(urls.storage_kind("url").alias("found"), "kind", urls.location_name("url").alias("name"))
    assert all(row.found == row.kind for row in got.collect()) and got.first().name == "k x"


def test_an_object_that_repeats_a_key(spark):
    docs = spark.createDataFrame([('{"a":1,"a":2}',), ('{"b":1}',)], "doc string")
    assert [row[0] for row in docs.select(jsonfn.json_set("doc", "c", F.lit("x"))).collect()] == [None, '{"b":1,"c":"x"}']


def test_folder_sizes_add_up(spark):
    rows = [("/a/b/c/f", 1), ("/a/b/g", 2), ("/a/h", 4)]
    got = {r.folder: (r.files, r["size"]) for r in listing.folder_sizes(spark.createDataFrame(rows, "path string, size long")).collect()}
    assert got == {"/a/b/c": (1, 1), "/a/b": (2, 3), "/a": (3, 7)}


def test_dialects():
    assert dialect_of(["a;b", "1;2", '"x;y";3']) == (";", True)
    assert dialect_of(["1,2", "3,4"]) == (",", False)
    assert dialect_of(["name", "anna", "bert"])[0] is None
    assert delimited_lines("id,name\n1,a\n2,b\n") and not delimited_lines("Once, there was.\nThen, it ended, and so on.\nNo more.\n")


def test_rows_are_dealt_evenly_and_scratch_goes(spark):
    tasks = spread(spark.range(0, 64, 1, 1), "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 16 and {row["count"] for row in tasks} == {4}
    kept = write_and_read(spark.range(3), "kept")
    assert kept.count() == 3 and clear_scratch(spark) > 0
    assert clear_scratch(spark) == 0


def test_files_per_value_follow_its_rows(spark):
    path = scratch_path(spark, "sized")
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, "big").when(F.col("id") < 950, "small").alias("v"))
    export.partitioned_write(rows, path, "v", max_rows_per_file=100)
    files = spark.read.parquet(path).groupBy("v").agg(F.countDistinct("_metadata.file_path").alias("files"), F.count("*").alias("rows"))
    got = {row.v: (row.files, row["rows"]) for row in files.collect()}
    assert got["big"][0] >= 5 and got["small"] == (1, 50) and got[None] == (1, 50) and got["big"][1] == 900
