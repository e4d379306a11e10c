"""Profiles of small files, with the values their formats call for."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lakeprofile.plans import profile as plan
from lakeprofile.plans.preview import clamp_rows, preview, preview_info
from lakeprofile.plans.report import file_report
from lakeprofile.sources import documents
from lakeprofile.sources.inventory import inventory, list_level, list_location


def profiles(spark, folder):
    found = {}
    for row in plan.profile_location(spark, str(folder)).collect():
        found[os.path.relpath(row.path, folder)] = row
    return found


def columns(row):
    return {column.name: column for column in row.columns}


def write_iceberg(folder, versions, **extra):
    os.makedirs(folder / "metadata")
    for name, rows in versions.items():
        meta = {
            "format-version": 2, "current-schema-id": 1,
            "schemas": [
                {"schema-id": 0, "type": "struct", "fields": []},
                {"schema-id": 1, "type": "struct", "fields": [
                    {"id": 1, "name": "id", "required": True, "type": "long"},
                    {"id": 2, "name": "amount", "required": False, "type": "decimal(12, 2)"},
                    {"id": 3, "name": "tags", "required": False, "type": {"type": "list", "element": "string"}}]},
            ],
            "default-spec-id": 3, "partition-specs": [{"spec-id": 3, "fields": [{"name": "id_bucket"}]}],
            "current-snapshot-id": 5, "snapshots": [{"snapshot-id": 5, "summary": {"total-records": str(rows)}}],
            **extra,
        }
        (folder / "metadata" / name).write_text(json.dumps(meta))


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    (root / "wide.csv").write_text("id,description\n1," + "x" * 240 + "\n")
    (root / "semi.csv").write_text("a;b;c\n1;2;x\n3;4;y\n5;6;z\n")
    (root / "one.csv").write_text("name\nanna\nbert\n")
    (root / "empty.csv").write_bytes(b"")
    (root / "types.csv").write_text("n,f,b,s,gap,big,nb\n1,1.5,True,x,1,9223372036854775807,true\n"
                                    "2,2e3,False,y,,9223372036854775808,\n3,inf,True,1d,3,1,false\n")
    (root / "latin.csv").write_bytes("id,name\n1,Müller\n2,Größe\n".encode("cp1252"))
    (root / "mark.csv").write_bytes("id,name\n1,Müller\n".encode("utf-8-sig"))
    (root / "quoted.csv").write_text('id,note\n1,"two\nlines"\n2,x\n')
    (root / "long.csv").write_text("id,name\n1,a\n2,b,c\n3,d\n")
    (root / "rows.jsonl").write_text("".join(json.dumps({"id": n, "name": f"n{n}"}) + "\n" for n in range(350)))
    (root / "skips.ndjson").write_text('{"a":1}\nnot json\n\n{"b":{"c":[1]},"a":null}\n')
    (root / "array.json").write_text('[{"id":1,"x":null},7,{"id":2,"x":[1,2],"name":"zoë"}]')
    (root / "object.json").write_text('{"z":1.5,"a":{"b":1},\n"t":true}')
    (root / "bad.json").write_text("{not valid json}")
    (root / "noext").write_text('[{"a":1}]')
    (root / "note.txt").write_text("one\ntwo\nthree")
    (root / ".hidden.txt").write_text("x\n")
    (root / "_under.txt").write_text("x\n")
    pq.write_table(pa.table({"id": pa.array([1, 2, 3], pa.int64()), "s": ["a", "b", None]}), root / "t.parquet")
    (root / "fake.parquet").write_bytes(b"PAR1" + b"\0" * 20)
    (root / "binary.xls").write_bytes(b"\xd0\xcf\x11\xe0")

    delta = root / "fallback_delta"
    os.makedirs(delta / "_delta_log")
    pq.write_table(pa.table({"id": [1], "name": ["x"]}), delta / "part-0.parquet")
    pq.write_table(pa.table({"other": [1]}), delta / "_delta_log" / "00000000000000000002.checkpoint.parquet")
    write_iceberg(root / "ice", {"v9.metadata.json": 41, "v10.metadata.json": 42})
    (root / "ice" / "metadata" / "version-hint.text").write_text("9")
    write_iceberg(root / "ice_null", {"00001-table.metadata.json": 1}, **{"current-snapshot-id": None})
    return root


@pytest.fixture(scope="module")
def found(spark, lake):
    return profiles(spark, lake)


def test_string_widths_get_headroom(found):
    column = columns(found["wide.csv"])["description"]
    assert (column.observed_max_len, column.sized_len, column.sql_type) == (240, 300, "NVARCHAR(350)")
    assert all(column.nullable for column in found["wide.csv"].columns)
    assert found["wide.csv"].schema_inference == "full"


def test_dialects(found):
    assert (found["semi.csv"].delimiter, found["semi.csv"].has_header, found["semi.csv"].row_count) == (";", True, 3)
    assert (found["one.csv"].delimiter, found["one.csv"].has_header, found["one.csv"].row_count) == (",", True, 2)
    assert (found["quoted.csv"].row_count, found["quoted.csv"].quoted_breaks) == (2, True)
    assert found["semi.csv"].quoted_breaks is False
    assert "too many fields" in found["long.csv"].warning and found["long.csv"].schema_sample_size == 2


def test_csv_types(found):
    kinds = {name: column.detected_type for name, column in columns(found["types.csv"]).items()}
    assert kinds == {"n": "int64", "f": "float64", "b": "bool", "s": "object", "gap": "float64", "big": "float64",
                     "nb": "object"}


def test_encodings(found):
    assert (found["latin.csv"].encoding, found["latin.csv"].codepage) == ("cp1252", "1252")
    assert columns(found["latin.csv"])["name"].sample_value == "Müller"
    assert (found["mark.csv"].encoding, found["mark.csv"].codepage) == ("utf-8-sig", "65001")
    assert [column.name for column in found["mark.csv"].columns] == ["id", "name"]
    assert found["note.txt"].encoding == "ascii"
    assert (found["t.parquet"].encoding, found["t.parquet"].codepage) == ("binary", "ACP")


def test_line_delimited_json(found):
    rows = found["rows.jsonl"]
    assert (rows.json_format, rows.row_count, rows.schema_sample_size, rows.schema_inference) == (
        "ndjson", 350, 350, "full")
    skips = found["skips.ndjson"]
    assert (skips.row_count, skips.warning) == (2, "Skipped 1 invalid NDJSON line.")
    assert [(c.name, c.detected_type, c.nesting) for c in skips.columns] == [
        ("a", "int", "scalar"), ("b", "dict", "object")]


def test_json_documents(found):
    array = found["array.json"]
    assert (array.json_format, array.row_count, array.schema_inference) == ("array", 3, "sampled")
    assert [(c.name, c.detected_type, c.nesting) for c in array.columns] == [
        ("id", "int", "scalar"), ("x", "list", "array"), ("name", "str", "scalar")]
    assert columns(array)["name"].observed_max_len == 3
    single = found["object.json"]
    assert (single.json_format, single.row_count) == ("object", 1)
    assert [(c.name, c.detected_type) for c in single.columns] == [("z", "float"), ("a", "dict"), ("t", "bool")]
    assert found["bad.json"].file_type == "json" and found["bad.json"].error
    assert found["noext"].file_type == "json" and found["noext"].row_count == 1


def test_all_elements_of_an_array_count(spark, tmp_path):
    path = tmp_path / "big.json"
    rows = [{"id": n, "name": f"row {n}"} for n in range(900)] + [{"id": 900, "late": "x" * 70}, 5]
    path.write_text(json.dumps(rows))
    row = plan.profile_location(spark, str(path)).first()
    assert (row.json_format, row.row_count, row.schema_sample_size, row.schema_inference) == ("array", 902, 901, "sampled")
    assert [(c.name, c.observed_max_len) for c in row.columns] == [("id", None), ("name", 7), ("late", 70)]


def test_late_rows_decide_types_widths_and_keys(spark, tmp_path):
    lines = [f"{n},{n}" for n in range(1500)] + ["x" * 6000 + ",Größe", "7,8,9"]
    (tmp_path / "late.csv").write_text("a,b\n" + "\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "late.jsonl").write_text("\n".join([json.dumps({"a": n}) for n in range(400)] + [json.dumps({"a": 1, "z": "y" * 5_000_000})]) + "\n")
    found = {row.name: row for row in plan.profile_location(spark, str(tmp_path)).collect()}
    assert [(c.detected_type, c.observed_max_len) for c in found["late.csv"].columns] == [("object", 6000), ("object", 5)]
    assert found["late.csv"].warning == "Skipped 1 lines with too many fields." and found["late.csv"].schema_sample_size == 1501
    assert found["late.jsonl"].row_count == 401 and found["late.jsonl"].error is None
    assert [(c.name, c.observed_max_len) for c in found["late.jsonl"].columns] == [("a", None), ("z", 5_000_000)]


def test_plain_and_hidden_files(found):
    assert found["note.txt"].row_count == 3
    assert found[".hidden.txt"].row_count == 1 and found["_under.txt"].row_count == 1


def test_parquet(found):
    row = found["t.parquet"]
    assert (row.row_count, row.column_count, row.compression, row.parquet.num_row_groups) == (3, 2, "SNAPPY", 1)
    assert [(c.name, c.detected_type, c.sql_type) for c in row.columns] == [
        ("id", "int64", "BIGINT"), ("s", "string", "NVARCHAR(255)")]
    assert found["fake.parquet"].error


def test_errors_are_rows(found):
    assert found["empty.csv"].error and found["binary.xls"].error
    assert found["wide.csv"].error is None


def test_delta_falls_back_to_a_data_file(found):
    row = found["fallback_delta"]
    assert (row.file_type, row.row_count, row.schema_inference) == ("delta", None, "underlying_parquet_file")
    assert [column.name for column in row.columns] == ["id", "name"] and row.warning


def test_iceberg_takes_the_highest_version(found):
    row = found["ice"]
    assert (row.row_count, row.iceberg.metadata_file, row.schema_inference) == (42, "v10.metadata.json",
                                                                               "iceberg_metadata")
    assert [(c.name, c.detected_type, c.nullable) for c in row.columns] == [
        ("id", "int64", False), ("amount", "decimal128", True), ("tags", "list", True)]
    assert columns(row)["amount"].spark_type == "decimal(12, 2)"
    assert json.loads(row.iceberg.partition_spec) == [{"name": "id_bucket"}]
    assert found["ice_null"].row_count == 0


def test_one_row_per_entry_and_summary_adds_up(spark, lake, found):
    entries = inventory(spark, str(lake)).count()
    assert entries == len(found)
    summary = plan.location_summary(plan.profile_location(spark, str(lake))).collect()
    assert sum(row.files for row in summary) == entries
    assert sum(row.failed for row in summary) == sum(row.error is not None for row in found.values())


def test_column_count_matches_the_columns(found):
    for row in found.values():
        assert row.column_count == (len(row.columns) if row.columns is not None else None)


def test_folder_scan_prunes(spark, tmp_path):
    for name in ("keep/a.txt", ".git/b.txt", "__pycache__/c.txt", "keep/.d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    scanned = {row.name for row in plan.profile_folder(spark, str(tmp_path)).collect()}
    assert scanned == {"a.txt", ".d.txt"}
    assert inventory(spark, str(tmp_path)).count() == 4


def test_missing_and_empty_locations(spark, tmp_path):
    assert "does not exist" in plan.profile_location(spark, str(tmp_path / "gone")).first().error
    assert "No files found" in plan.profile_location(spark, str(tmp_path)).first().error


def test_explicit_paths_keep_their_place(spark, lake):
    paths = spark.createDataFrame([(0, str(lake / "t.parquet")), (1, str(lake / "gone.csv")), (2, str(lake / "ice"))],
                                  "ordinal int, path string")
    rows = plan.profile_paths(paths).orderBy("ordinal").collect()
    assert [row.file_type for row in rows] == ["parquet", "unknown", "iceberg"]
    assert rows[1].error and rows[2].row_count == 42


def test_listing_fans_out_when_a_task_hands_folders_back(spark, tmp_path, monkeypatch):
    for outer in range(4):
        for inner in range(3):
            folder = tmp_path / f"d{outer}" / f"e{inner}"
            folder.mkdir(parents=True)
            (folder / "f.txt").write_text("x")
    monkeypatch.setattr("lakeprofile.sources.inventory.FOLDERS_PER_TASK_ROW", 2)
    listing = list_location(spark, str(tmp_path))
    assert listing.filter("kind = 'file'").select("path").distinct().count() == 12
    assert listing.count() == 12


def test_one_level(spark, lake):
    level = {row.name: (row.kind, row.table_type) for row in list_level(spark, str(lake.parent)).collect()}
    assert level[lake.name] == ("folder", None)
    level = {row.name: row for row in list_level(spark, str(lake)).collect()}
    assert level["ice"].table_type == "iceberg" and level["ice"].size > 0


@pytest.mark.parametrize("name, rows", [
    ("semi.csv", [("1", "2", "x"), ("3", "4", "y")]),
    ("rows.jsonl", [("0", "n0"), ("1", "n1")]),
    ("t.parquet", [(1, "a"), (2, "b")]),
    ("note.txt", [("one",), ("two",)]),
    ("fallback_delta", [(1, "x")]),
])
def test_preview(spark, lake, name, rows):
    assert [tuple(row) for row in preview(spark, str(lake / name), 2).collect()] == rows


def test_preview_limits():
    assert [clamp_rows(n) for n in (-5, 0, 7, 99999)] == [1, 1, 7, 10000]


def test_report_defines_every_sound_file(spark, lake):
    report = {os.path.relpath(row.path, lake): row for row in
              file_report(plan.profile_location(spark, str(lake))).collect()}
    assert "[description] NVARCHAR(350)" in report["wide.csv"].create_table
    assert "[id] BIGINT" in report["ice"].create_table and "NOT NULL" in report["ice"].create_table
    assert report["bad.json"].create_table is None and report["bad.json"].error
    assert "bulk_insert" in report["wide.csv"].load_methods
    assert report["semi.csv"].reader_options["sep"] == ";"
    assert report["quoted.csv"].reader_options["multiLine"] == "true"
    options = report["quoted.csv"].reader_options
    assert spark.read.options(**options).csv(str(lake / "quoted.csv")).count() == 2
    assert any("Nested JSON" in warning for warning in report["array.json"].warnings)


def test_repeated_column_names_are_refused(spark, tmp_path):
    (tmp_path / "dup.csv").write_text("id,ID\n1,2\n3,4\n")
    row = file_report(plan.profile_location(spark, str(tmp_path))).first()
    assert row.create_table is None and row.error == "Duplicate column name: ID"


def test_profiles_scan_only_what_they_need(spark, lake):
    summary = plan.location_summary(plan.profile_location(spark, str(lake)))
    text = summary._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_workbooks(spark, tmp_path):
    import pandas as pd

    from queries.writers import workbook_bytes

    frame = pd.DataFrame({"id": [1, 2], "price": [1.5, 2.0], "name": ["a & b", "c"]})
    (tmp_path / "book.xlsx").write_bytes(workbook_bytes(frame))
    row = plan.profile_location(spark, str(tmp_path)).first()
    assert (row.file_type, row.row_count, row.row_count_lower_bound) == ("excel", 2, None)
    assert [(c.name, c.detected_type, c.sample_value) for c in row.columns] == [
        ("id", "int64", "1"), ("price", "float64", "1.5"), ("name", "object", "a & b")]
    assert [tuple(shown) for shown in preview(spark, str(tmp_path / "book.xlsx"), 1).collect()] == [("1", "1.5", "a & b")]


def test_workbooks_are_profiled_to_their_last_row(spark, tmp_path):
    import pandas as pd

    from queries.writers import workbook_bytes

    plain = pd.DataFrame({"id": range(450), "price": [2] * 450, "name": ["c"] * 450})
    late = plain.astype(object)
    late.loc[400, "id"], late.loc[401, "price"], late.loc[402, "name"] = "none", 2.5, "x" * 77
    (tmp_path / "plain.xlsx").write_bytes(workbook_bytes(plain))
    (tmp_path / "late.xlsx").write_bytes(workbook_bytes(late))
    (tmp_path / "head.xlsx").write_bytes(workbook_bytes(plain[:0]))
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    profiles = plan.profile_location(spark, str(tmp_path))
    rows = {os.path.basename(row.path): row for row in profiles.collect()}
    told = lambda name: [(c.name, c.detected_type, c.observed_max_len, c.sample_value) for c in rows[name].columns]
    assert (rows["late.xlsx"].row_count, rows["late.xlsx"].row_count_lower_bound, rows["late.xlsx"].schema_inference) == (450, None, "full")
    assert told("plain.xlsx") == [("id", "int64", None, "0"), ("price", "int64", None, "2"), ("name", "object", 1, "c")]
    assert told("late.xlsx") == [("id", "object", 4, "0"), ("price", "float64", None, "2"), ("name", "object", 77, "c")]
    assert rows["head.xlsx"].row_count == 0 and told("head.xlsx") == [(n, "object", None, None) for n in ("id", "price", "name")]
    assert rows["bad.xlsx"].error and rows["bad.xlsx"].row_count is None and rows["bad.xlsx"].columns is None
    assert plan.location_summary(profiles).filter("file_type = 'excel'").first().total_rows == 900


def test_workbook_gaps_and_columns_of_late_rows(spark, tmp_path):
    import io
    import zipfile

    import pandas as pd

    from queries.writers import workbook_bytes

    source = zipfile.ZipFile(io.BytesIO(workbook_bytes(pd.DataFrame({"a": [1]}))))
    body = "".join(f'<row r="{r}"><c r="A{r}"><v>{r}</v></c></row>' for r in range(2, 300))
    sheet = source.read("xl/worksheets/sheet1.xml").decode().replace("</sheetData>", "").replace("</worksheet>", "")
    sheet = sheet[:sheet.index("<row>")] + '<row r="1"><c r="A1" t="inlineStr"><is><t>a</t></is></c></row>' + body
    sheet += '<row r="301"><c r="B301"><v>7</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "gap.xlsx", "w") as book:
        for name in source.namelist():
            book.writestr(name, sheet if name.endswith("sheet1.xml") else source.read(name))
    row = plan.profile_location(spark, str(tmp_path)).first()
    assert row.row_count == 300
    assert [(c.name, c.detected_type, c.sample_value) for c in row.columns] == [("a", "float64", "2"), ("Unnamed: 1", "float64", "7")]


def test_browse_and_preview_info(spark, lake):
    level = {row.name: row for row in plan.browse(spark, str(lake)).collect()}
    assert level["ice"].file_type == "iceberg" and level["noext"].file_type == "json"
    info = {os.path.basename(row.path): row for row in
            preview_info(plan.profile_location(spark, str(lake)), 100).collect()}
    assert (info["rows.jsonl"].total_rows, info["rows.jsonl"].truncated) == (350, True)
    assert (info["semi.csv"].total_rows, info["semi.csv"].truncated) == (3, False)
    assert info["bad.json"].error
