"""Operators on tables: loads, overrides, listings under skew, plans."""

import pytest
from pyspark.sql import functions as F, types as T

from lakeprofile.operators import columns, export, listing, loading
from lakeprofile.session import scratch_path
from lakeprofile.sources.delimited import read_delimited, read_with_rejects, row_estimate

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def target(spark, label):
    path = scratch_path(spark, label)
    name = f"{label}_{path.split('/')[-2]}"
    spark.catalog.createTable(name, path=path, source="parquet", schema=SCHEMA)
    return name


def test_reject_limit_is_exact(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,name\n1,a\nx,b\n3,c,d\n4,e\n")
    table = target(spark, "rejects")
    with pytest.raises(loading.RejectLimitExceeded):
        loading.bulk_load(spark, str(tmp_path), table, SCHEMA, max_errors=1)
    assert spark.table(table).count() == 0
    assert loading.bulk_load(spark, str(tmp_path), table, SCHEMA, max_errors=2) == 2
    assert sorted(row.id for row in spark.table(table).collect()) == [1, 4]


def test_rejects_do_not_depend_on_the_columns_asked_for(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,name\n1,a\nx,b\n")
    rows = read_with_rejects(spark, str(tmp_path), SCHEMA)
    assert [row.name for row in rows.filter("_rejected IS NOT NULL").select("name", "_rejected").collect()] == ["b"]
    assert rows.filter("_rejected IS NOT NULL").count() == 1


def test_overrides_follow_the_original_name(spark):
    rows = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double")
    changed = columns.apply_overrides(rows, {"a": {"name": "b2", "type": "string"}, "c": {"excluded": True},
                                             "b": {"nullable": False}})
    assert [tuple(row) for row in changed.collect()] == [("1", "x")] and changed.columns == ["b2", "b"]
    empty = spark.createDataFrame([(None,)], "b string")
    with pytest.raises(Exception, match="null"):
        columns.apply_overrides(empty, {"b": {"nullable": False}}).collect()


def test_manual_schema_refuses_repeats(spark):
    with pytest.raises(ValueError, match="Duplicate column name"):
        columns.schema_of_columns([("id", "bigint"), ("ID", "string")])


def test_table_files_under_a_hot_folder(spark):
    """A third of all files sits in one table, another third loose in one folder."""
    paths = (
        [f"/lake/hot/t/part-{n}.parquet" for n in range(400)] + ["/lake/hot/t/_delta_log/0.json"]
        + [f"/lake/hot/f{n}.csv" for n in range(400)]
        + [f"/lake/d{n}/u/data/f.parquet" for n in range(200)]
        + [f"/lake/d{n}/u/metadata/v1.METADATA.json" for n in range(0, 200, 2)]
        + ["/lake/hot/t/inner/metadata/v1.metadata.json"]
    )
    rows = spark.createDataFrame([(path, 1) for path in paths], "path string, size bigint")
    entries = {row.path: row for row in listing.collapse_listing(listing.tag_table_files(rows)).collect()}
    assert entries["/lake/hot/t"].files == 402 and entries["/lake/hot/t"].entry_type == "delta"
    assert entries["/lake/d0/u"].entry_type == "iceberg" and entries["/lake/d0/u"].files == 2
    assert "/lake/d1/u" not in entries and entries["/lake/d1/u/data/f.parquet"].entry_type == "file"
    assert sum(row.files for row in entries.values()) == len(paths)


def test_tagging_is_an_equi_join(spark):
    rows = spark.createDataFrame([("/a/_delta_log/0.json", 1)], "path string, size bigint")
    plan = listing.tag_table_files(rows)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_first_rows_are_cut_before_the_shuffle(spark):
    rows = spark.range(10_000).select((F.col("id") % 3).alias("file"), "id")
    kept = columns.first_rows(rows, "file", "id", 5)
    assert kept.count() == 15
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_partitioned_write_splits_a_hot_value(spark, tmp_path):
    # Equal rows, and a column whose type has no order.
    rows = spark.range(4000).select(F.when(F.col("id") < 3900, "hot").when(F.col("id") < 3950, "cold").alias("k"), F.lit(1).alias("same"),
                                    F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    path = str(tmp_path / "out")
    # Adaptive execution would merge parts this small.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        export.partitioned_write(rows, path, "k", max_rows_per_file=600)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    written = spark.read.parquet(path)
    assert {r.k: r["count"] for r in written.groupBy("k").count().collect()} == {"hot": 3900, "cold": 50, None: 50}
    assert written.filter("same = 1 AND m['a'] = 1").count() == 4000
    assert len(list((tmp_path / "out" / "k=hot").glob("part-*.parquet"))) > 3
    assert len(list((tmp_path / "out" / "k=cold").glob("part-*.parquet"))) == 1


def test_row_estimate(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("id,name\n" + "".join(f"{n:06d},name\n" for n in range(5000)))
    files = spark.createDataFrame([(str(path), path.stat().st_size, True)], "path string, size bigint, has_header boolean")
    assert abs(row_estimate(files, 500).first().row_estimate - 5000) <= 50


def test_signatures_follow_the_log_folder(spark):
    rows = spark.createDataFrame([
        ("/t", "table", None, 1, "/t"), ("/t/_delta_log/0.json", "file", 5, 9, "/t"),
        ("/t/part.parquet", "file", 100, 20, "/t"), ("/x.csv", "file", 7, 3, None),
    ], "path string, kind string, size bigint, modified bigint, table_root string")
    found = {row.path: (row.modified, row.size) for row in listing.table_signatures(rows).collect()}
    assert found == {"/t": (9, 5), "/x.csv": (3, 7)}


def test_headerless_names(spark, tmp_path):
    (tmp_path / "h.csv").write_text("1,a\n2,b\n")
    rows = read_delimited(spark, str(tmp_path), has_header=False)
    assert rows.columns == ["column_1", "column_2"] and rows.count() == 2
