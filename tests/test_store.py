"""Profiles kept from run to run."""

import os

import pytest

from lakeprofile.operators import listing
from lakeprofile.plans import store
from lakeprofile.plans.profile import profile_location


def plain(df, *without):
    names = [name for name in df.columns if name not in ("part", *without)]
    return sorted(str(row) for row in df.select(*sorted(names)).collect())


@pytest.fixture
def lake(tmp_path):
    folder = tmp_path / "lake"
    folder.mkdir()
    (folder / "a.csv").write_text("x,y\n1,2\n")
    (folder / "b.csv").write_text("x,y\n1,a\n")
    (folder / "broken.json").write_text('{"a": 1')
    return folder


def test_only_changes_are_profiled(spark, lake, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    assert store.refresh(spark, str(lake), path) == 0
    assert plain(store.stored_profiles(spark, path)) == plain(profile_location(spark, str(lake)))
    seen = []
    monkeypatch.setattr(store, "profile_listing", lambda rows, *more: seen.extend(row.path for row in rows.collect()) or real(rows, *more))
    assert store.refresh(spark, str(lake), path) == 1 and not seen
    # Same size and another time; a new file; one that goes.
    os.utime(lake / "a.csv", (1, 1))
    (lake / "c.csv").write_text("z\n5\n")
    (lake / "b.csv").unlink()
    assert store.refresh(spark, str(lake), path) == 2
    assert sorted(name.rsplit("/", 1)[1] for name in seen) == ["a.csv", "c.csv"]
    assert plain(store.stored_profiles(spark, path)) == plain(profile_location(spark, str(lake)))
    assert {(row.path.rsplit("/", 1)[1], row.change) for row in store.stored_changes(spark, path).collect()} == {
        ("a.csv", "changed"), ("c.csv", "added"), ("b.csv", "removed")}
    counts = [(row.version, row.profiled, row.kept, row.removed) for row in store.history(spark, path).orderBy("version").collect()]
    assert counts == [(0, 3, 0, 0), (1, 0, 3, 0), (2, 2, 1, 1)]
    # Older versions stay readable.
    assert store.stored_profiles(spark, path, 0).filter("name = 'b.csv'").count() == 1
    seen.clear()
    assert store.refresh(spark, str(lake), path, retry_failed=True) == 3
    assert [name.rsplit("/", 1)[1] for name in seen] == ["broken.json"]


real = store.profile_listing


def test_nothing_counts_before_it_is_published(spark, lake, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store.refresh(spark, str(lake), path)
    before = plain(store.stored_profiles(spark, path))
    (lake / "a.csv").write_text("x,y\n1,2\n3,4\n")
    publish = store._publish

    def die(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "_publish", die)
    with pytest.raises(RuntimeError):
        store.refresh(spark, str(lake), path)
    assert plain(store.stored_profiles(spark, path)) == before
    monkeypatch.setattr(store, "_publish", publish)
    assert store.refresh(spark, str(lake), path) == 1
    assert store.stored_profiles(spark, path).filter("name = 'a.csv'").first().row_count == 2


def test_a_number_is_given_once(spark, lake, tmp_path):
    path = str(tmp_path / "store")
    store.refresh(spark, str(lake), path)
    taken = store.history(spark, path).first().asDict()
    with pytest.raises(store.StoreConflict):
        store._publish(spark, path, {**taken, "entries": "other"})
    assert store.history(spark, path).first().asDict() == taken


def test_refusals(spark, lake, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError, match="no version"):
        store.stored_profiles(spark, path)
    store.refresh(spark, str(lake), path)
    with pytest.raises(ValueError, match="profiles of"):
        store.refresh(spark, str(tmp_path), path)
    with pytest.raises(ValueError, match="no version 7"):
        store.stored_profiles(spark, path, 7)


def test_empty_location(spark, tmp_path):
    folder, path = tmp_path / "lake", str(tmp_path / "store")
    folder.mkdir()
    store.refresh(spark, str(folder), path)
    assert store.stored_profiles(spark, path).first().error == "No files found at the specified location"
    (folder / "a.csv").write_text("x\n1\n")
    store.refresh(spark, str(folder), path)
    assert [row.name for row in store.stored_profiles(spark, path).collect()] == ["a.csv"]


def test_digest_sees_files_that_change_places(spark):
    rows = [("/t/x", "/t", 1, 10), ("/t/y", "/t", 2, 20)]
    swapped = [("/t/x", "/t", 2, 20), ("/t/y", "/t", 1, 10)]
    schema = "path string, table_root string, modified int, size bigint"
    one, two = (listing.entry_signatures(spark.createDataFrame(each, schema)) for each in (rows, swapped))
    assert listing.changed_files(two, one).count() == 0
    assert listing.changed_files(two, one, "files", "digest").count() == 1
