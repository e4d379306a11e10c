"""Reading a location as its profile says."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from lakeprofile.plans import reading
from lakeprofile.plans.profile import profile_folder, profile_location
from lakeprofile.plans.reading import FILE_PATH, join_schemas, join_types, read_location, widened


def parsed(text):
    return T._parse_datatype_string(text)


@pytest.mark.parametrize("a, b, joined", [
    ("int", "bigint", "bigint"), ("tinyint", "smallint", "smallint"), ("int", "double", "double"), ("bigint", "decimal(10,2)", "decimal(21,2)"),
    ("decimal(38,0)", "decimal(10,5)", "string"), ("boolean", "int", "string"), ("date", "timestamp", "timestamp"), ("date", "timestamp_ntz", "timestamp_ntz"),
    ("string", "double", "string"), ("void", "int", "int"), ("array<int>", "array<double>", "array<double>"), ("map<string,int>", "int", "string"),
    ("struct<a:int,b:string>", "struct<B:string,A:bigint,c:date>", "struct<a:bigint,b:string,c:date>"),
])
def test_types_join(spark, a, b, joined):
    assert join_types(parsed(a), parsed(b)) == parsed(joined)
    assert join_types(parsed(b), parsed(a)).typeName() == parsed(joined).typeName()


def test_values_are_widened(spark):
    kind = parsed("struct<a:int,b:array<struct<x:int>>>")
    wanted = parsed("struct<b:array<struct<x:bigint,y:string>>,a:string>")
    rows = spark.createDataFrame([((1, [(2,), None]),), (None,)], T.StructType([T.StructField("v", kind)]))
    got = [r.v for r in rows.select(widened(F.col("v"), kind, wanted).alias("v")).collect()]
    assert got[0].asDict(True) == {"b": [{"x": 2, "y": None}, None], "a": "1"} and got[1] is None
    assert rows.select(widened(F.col("v"), kind, T.StringType()).alias("v")).first().v == '{"a":1,"b":[{"x":2},null]}'


def test_schemas_join_without_regard_to_case(spark):
    assert join_schemas([parsed("struct<Id:int,a:string>"), parsed("struct<b:date,ID:bigint>")]) == parsed("struct<Id:bigint,a:string,b:date>")


def rows_of(df, *columns):
    """Rows as tuples of file name and values, in order."""
    name = F.regexp_extract(FILE_PATH, "[^/]*$", 0)
    return sorted((tuple(r) for r in df.select(name, *columns).collect()), key=str)


def test_dialects_of_one_folder_are_told_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"x, ""y"""\n2,\n')
    (tmp_path / "b.csv").write_bytes("id;name;more\n3;Größe €;7\n4;z;8\n".encode("cp1252"))
    (tmp_path / "c.csv").write_text('id,name\n5,"line\nbreak"\n6,q\n')
    (tmp_path / "broken.csv").write_text("")
    (tmp_path / "_hidden.csv").write_text("id,name\n9,hidden\n")
    rows = read_location(spark, str(tmp_path))
    assert rows.schema["id"].dataType == T.LongType() and rows.schema["more"].dataType == T.LongType()
    assert rows_of(rows, "id", "name", "more") == [
        ("a.csv", 1, 'x, "y"', None), ("a.csv", 2, None, None), ("b.csv", 3, "Größe €", 7), ("b.csv", 4, "z", 8),
        ("c.csv", 5, "line\nbreak", None), ("c.csv", 6, "q", None)]
    assert {r.path.rsplit("/", 1)[1] for r in reading.unread(profile_folder(spark, str(tmp_path))).collect()} == {"broken.csv", "_hidden.csv"}


def test_records_the_profile_skips_are_left_out(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y,too,many\n3\n")
    assert rows_of(read_location(spark, str(tmp_path)), "id", "name") == [("a.csv", 1, "x"), ("a.csv", 3, None)]


def test_json_keys_of_mixed_kinds_lose_nothing(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "n": {"deep": [1, 2]}, "big": 1}\n{"k": "x", "big": 12345678901234567890}\nno json\n{"k": null, "f": 1}\n')
    (tmp_path / "b.json").write_text(json.dumps([{"k": True, "f": 1.5}, {"other": "y"}]))
    rows = read_location(spark, str(tmp_path))
    assert rows.schema["big"].dataType == T.DecimalType(38, 0) and rows.schema["f"].dataType == T.DoubleType()
    assert [(r[0], r[1], r[2] and json.loads(r[2]), r[3] and int(r[3]), r[4], r[5]) for r in rows_of(rows, "k", "n", "big", "f", "other")] == [
        ("a.jsonl", "1", {"deep": [1, 2]}, 1, None, None), ("a.jsonl", "x", None, 12345678901234567890, None, None), ("a.jsonl", None, None, None, 1.0, None),
        ("b.json", "true", None, None, 1.5, None), ("b.json", None, None, None, None, "y")]


def test_text_of_several_encodings(spark, tmp_path):
    for name, codec in (("a", "utf-8"), ("b", "cp1252"), ("c", "utf-16"), ("d", "utf-8-sig")):
        (tmp_path / f"{name}.txt").write_bytes("prose of é€  \nsecond line".encode(codec))
    assert rows_of(read_location(spark, str(tmp_path)), "line") == sorted(
        (f"{name}.txt", line) for name in "abcd" for line in ("prose of é€", "second line"))


def test_columnar_files_widen_to_each_other(spark, tmp_path):
    spark.range(3).select(F.col("id").cast("int").alias("id"), F.struct(F.lit(1).alias("a")).alias("s")).coalesce(1).write.parquet(str(tmp_path / "x"))
    spark.range(3, 5).select("id", F.struct(F.lit("t").alias("b")).alias("s")).coalesce(1).write.orc(str(tmp_path / "y"))
    rows = read_location(spark, str(tmp_path))
    assert rows.schema["id"].dataType == T.LongType()
    assert sorted((r.id, r.s.a, r.s.b) for r in rows.collect()) == [(0, 1, None), (1, 1, None), (2, 1, None), (3, None, "t"), (4, None, "t")]


def test_tables_and_odd_folder_names(spark, tmp_path):
    odd = tmp_path / "q[1]{x}*"
    odd.mkdir()
    (odd / "a.csv").write_text("id,name\n1,x\n")
    root = tmp_path / "t.delta"
    spark.range(10, 12).coalesce(1).write.parquet(str(root))
    (root / "_delta_log").mkdir()
    data = next(root.glob("part-*.parquet")).name
    (root / "_delta_log" / f"{0:020}.json").write_text("\n".join([
        json.dumps({"metaData": {"id": "t", "schemaString": json.dumps({"type": "struct", "fields": [{"name": "id", "type": "long", "nullable": True}]}), "partitionColumns": []}}),
        json.dumps({"add": {"path": data, "stats": '{"numRecords": 2}'}})]))
    spark.range(20, 21).coalesce(1).write.parquet(str(tmp_path / "loose"))
    rows = read_location(spark, str(tmp_path))
    assert sorted(r.id for r in rows.collect()) == [1, 10, 11, 20]


def test_one_file_and_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n")
    (tmp_path / "b.csv").write_text("id,name\n2,x\n")
    assert rows_of(read_location(spark, str(tmp_path / "a.csv")), "id") == [("a.csv", 1)]
    (tmp_path / "none").mkdir()
    assert read_location(spark, str(tmp_path / "none")).count() == 0


def test_folders_are_named_and_not_files(spark, tmp_path):
    for folder in ("p/one", "p/two", "q"):
        (tmp_path / folder).mkdir(parents=True)
    for at in range(3):
        (tmp_path / "p/one" / f"{at}.csv").write_text("id,name\n1,x\n")
        (tmp_path / "p/two" / f"{at}.csv").write_text("id,name\n1,x\n")
        (tmp_path / "q" / f"{at}.csv").write_text("id;name\n1;x\n" if at else "id,name\n1,x\n")
    files = reading.planned_files(profile_location(spark, str(tmp_path)))
    covers = sorted((r.folder.replace(str(tmp_path), ""), r.layout.delimiter, r.pure) for r in reading.covering_folders(files, str(tmp_path)).collect())
    assert covers == [("/p", ",", True), ("/q", ",", False), ("/q", ";", False)]
