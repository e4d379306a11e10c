"""Tables written as one JSON document."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lakeprofile.operators import export
from lakeprofile.session import rename_once


def test_one_valid_document_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "_COPY_BYTES", 7)
    rows = spark.range(500).repartition(6).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('ü"\n'), "id")).alias("some name"))
    path = str(tmp_path / "all.json")
    size = export.export_document(rows, path, F.desc("id"))
    text = (tmp_path / "all.json").read_bytes()
    assert len(text) == size and set(os.listdir(tmp_path)) == {"all.json"}
    assert json.loads(text) == [{"id": n, **({"some name": f'ü"\n{n}'} if n % 3 else {})} for n in range(499, -1, -1)]


@pytest.mark.parametrize("root, expected", [(None, []), ('a "b"', {'a "b"': []})])
def test_empty_and_root(spark, tmp_path, root, expected):
    export.export_document(spark.range(0), str(tmp_path / "empty.json"), "id", root=root)
    assert json.loads((tmp_path / "empty.json").read_text()) == expected
    export.export_document(spark.range(1), str(tmp_path / "one.json"), root=root)
    rows = json.loads((tmp_path / "one.json").read_text())
    assert (rows if root is None else rows[root]) == [{"id": 0}]


def test_ties_nulls_and_taken_names(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (1, None), (None, "x")], "k int, v string")
    path = str(tmp_path / "ties.json")
    export.export_document(rows, path, "k", include_nulls=True)
    assert json.loads((tmp_path / "ties.json").read_text()) == [{"k": None, "v": "x"}, {"k": 1, "v": None}, {"k": 1, "v": None}]
    with pytest.raises(FileExistsError):
        export.export_document(rows, path, "k")
    (tmp_path / "other").write_text("")
    with pytest.raises(FileExistsError):
        rename_once(spark, str(tmp_path / "other"), path)
    assert (tmp_path / "other").exists()


def test_a_task_that_runs_again_changes_nothing(tmp_path):
    path = str(tmp_path / "f")
    export.write_at(path, 4, b"late")
    export.write_at(path, 0, b"soon")
    export.write_at(path, 4, b"late")
    assert (tmp_path / "f").read_bytes() == b"soonlate"
