"""Deletion vectors against sets of positions, and the tables they belong to."""

import base64
import struct
import uuid
import zlib

import numpy as np
import pytest
from hypothesis import given, strategies as st

from lakeprofile.sources import deletions
from lakeprofile.sources.storage import Storage
from queries.writers import vector_bytes, vector_text

POSITIONS = st.one_of(
    st.sets(st.integers(0, 200)), st.sets(st.integers(0, 2**40), max_size=50),
    st.tuples(st.integers(0, 2**33), st.integers(1, 9000)).map(lambda span: set(range(span[0], span[0] + span[1]))))


@given(POSITIONS, st.booleans())
def test_what_is_written_is_read(positions, runs):
    array = np.array(sorted(positions), np.int64)
    assert deletions.vector_positions(vector_bytes(array, runs)).tolist() == array.tolist()


def test_a_vector_written_by_hand():
    # One bitmap of upper half 0: one list container of key 1 with the values 5 and 7.
    bitmap = struct.pack("<IIHHI", 12346, 1, 1, 1, 16) + struct.pack("<HH", 5, 7)
    assert deletions.vector_positions(struct.pack("<iQI", 1681511377, 1, 0) + bitmap).tolist() == [65541, 65543]
    # A run container without offsets: the values 3, 4, 5.
    runs = struct.pack("<I", 12347) + b"\x01" + struct.pack("<HH", 0, 2) + struct.pack("<HHH", 1, 3, 2)
    assert deletions.vector_positions(struct.pack("<iQI", 1681511377, 1, 2) + runs).tolist() == [2**33 + 3, 2**33 + 4, 2**33 + 5]


@pytest.mark.parametrize("data", [b"", b"\0" * 12, struct.pack("<iQ", 1681511377, 1), struct.pack("<iQI", 1681511377, 1, 0) + b"\1\2\3\4\5\6\7\x08"])
def test_broken_vectors_are_refused(data):
    with pytest.raises(deletions.BrokenVector):
        deletions.vector_positions(data)


def test_places_of_vectors(tmp_path):
    data, name = vector_bytes(np.arange(3)), uuid.uuid4()
    stored = b"\x01" + b"other" + struct.pack(">i", len(data)) + data + struct.pack(">I", zlib.crc32(data))
    (tmp_path / "p").mkdir()
    for folder in (".", "p"):
        (tmp_path / folder / f"deletion_vector_{name}.bin").write_bytes(stored)
    text = base64.z85encode(name.bytes).decode()
    storage, root = Storage(), str(tmp_path)
    for kind, place, offset in (("u", text, 6), ("u", f"p{text}", 6), ("p", str(tmp_path / f"deletion_vector_{name}.bin"), 6), ("i", vector_text(data), None)):
        assert deletions.vector_bytes(storage, root, kind, place, offset, len(data)) == data
    (tmp_path / f"deletion_vector_{name}.bin").write_bytes(stored[:-1] + bytes([stored[-1] ^ 1]))
    with pytest.raises(deletions.BrokenVector):
        deletions.vector_bytes(storage, root, "u", text, 6, len(data))
