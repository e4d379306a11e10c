"""Array elements in ranges against a parser of the whole."""

import json

import pytest
from hypothesis import given, settings, strategies as st

from lakeprofile.plans.profile import profile_location
from lakeprofile.sources import arrays
from lakeprofile.sources.storage import Storage

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-5, 5) | st.text(alphabet='a"\\[]{},é \n', max_size=6),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(alphabet='k"\\]', max_size=3), inner, max_size=3), max_leaves=8)


def in_ranges(path, data: bytes, size: int):
    """All (text, problem), chunk by chunk."""
    path.write_bytes(data)
    state, depth, found = arrays.OUTSIDE, 0, []
    for offset in range(0, max(len(data), 1), size):
        found += arrays.elements_of_range(Storage(), str(path), offset, size, state, depth)
        change, _, state = arrays.scan(data[offset: offset + size], state)
        depth += int(change.sum())
    return found, (state, depth)


@settings(max_examples=300, deadline=None)
@given(st.lists(VALUES, max_size=6), st.integers(1, 40), st.booleans())
def test_elements_in_chunks(tmp_path_factory, values, size, indented):
    path = tmp_path_factory.mktemp("a") / "a.json"
    data = json.dumps(values, indent=1 if indented else None, ensure_ascii=indented).encode()
    found, end = in_ranges(path, data, size)
    assert [json.loads(text) for text, problem in found] == values and not any(problem for _, problem in found)
    assert end == (arrays.OUTSIDE, 0)


BROKEN = [b"[1,2", b"[1,,2]", b"[,1]", b"[1,]", b"[1]]", b"[1] x", b"[1][2]", b"{}", b'["a]', b"[1}", b"x[1]"]


@pytest.mark.parametrize("data", BROKEN)
@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_what_is_no_array_is_told(tmp_path, data, size):
    found, end = in_ranges(tmp_path / "a.json", data, size)
    assert any(problem for _, problem in found) or end != (arrays.OUTSIDE, 0)


def test_profiles_of_long_arrays(spark, tmp_path):
    rows = [{"id": i, "name": f'n"{i}]', "deep": {"a": [1, {"b": "}"}]}} for i in range(60)]
    (tmp_path / "a.json").write_text(json.dumps(rows + [5, "text"]))
    (tmp_path / "broken.json").write_text(json.dumps(rows)[:-1])
    (tmp_path / "inner.json").write_text(json.dumps(rows)[:-1] + ", {nope}]")
    (tmp_path / "numbers.json").write_text(json.dumps(list(range(100))))
    ranges = {r.name: r for r in profile_location(spark, str(tmp_path), chunk_bytes=64).collect()}
    whole = {r.name: r for r in profile_location(spark, str(tmp_path)).collect()}
    for name, row in whole.items():
        for field in ("row_count", "json_format", "error", "columns", "schema_sample_size"):
            assert ranges[name][field] == row[field], (name, field)
    assert (whole["a.json"].row_count, whole["a.json"].json_format) == (62, "array") and whole["broken.json"].error and whole["inner.json"].error
