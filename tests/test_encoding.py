"""The encoding of whole files against Python's own codecs."""

import pytest
from hypothesis import given, strategies as st

from lakeprofile.plans.profile import profile_location
from lakeprofile.sources import encoding
from lakeprofile.sources.encoding import BROKEN, START, STATES, utf8_outcomes, whole_encodings


def valid(data: bytes) -> bool:
    try:
        data.decode("utf-8")
        return True
    except UnicodeDecodeError:
        return False


PIECES = st.lists(st.one_of(st.text(max_size=4).map(str.encode), st.binary(max_size=4),
                            st.sampled_from([b"\xe0\x80", b"\xed\xa0", b"\xf0\x8f", b"\xf4\x90", b"\xc1", b"\xf5", b"\xe0\xa0\x80", b"\xf4\x8f\xbf\xbf"])), max_size=8)


@given(PIECES, st.lists(st.integers(0, 60), max_size=5))
def test_chunks_in_order_tell_what_the_whole_tells(pieces, cuts):
    data = b"".join(pieces)
    edges = [0, *sorted(min(cut, len(data)) for cut in cuts), len(data)]
    state = START
    for begin, end in zip(edges, edges[1:]):
        state = utf8_outcomes(data[begin:end])[state]
    assert (state == START) == valid(data)


@given(st.binary(max_size=6))
def test_outcomes_equal_the_walk(data):
    def walked(state):
        for byte in data:
            state = encoding.step(state, byte)
        return state

    assert utf8_outcomes(data) == [walked(state) for state in range(STATES)]
    assert utf8_outcomes(data)[BROKEN] == BROKEN


def test_long_pieces_cut_characters(monkeypatch):
    monkeypatch.setattr(encoding, "_STEP", 7)
    data = ("aé漢\U0001f600" * 50).encode()
    assert all(utf8_outcomes(data[:cut])[START] == (START if valid(data[:cut]) else utf8_outcomes(data[:cut])[START]) for cut in range(len(data)))
    assert utf8_outcomes(data)[START] == START


CASES = {
    "ascii": b"a" * 5000, "utf-8": b"a" * 4999 + "é".encode(), "cp1252": b"a" * 4999 + b"\xe9", "latin-1": b"a" * 4990 + b"\xe9\x81" + b"z" * 8,
    "utf-8-sig": b"\xef\xbb\xbf" + b"a" * 100, "cut": b"a" * 4999 + b"\xe2\x82",
}


@pytest.mark.parametrize("chunk_bytes", [4, 1000, 1 << 20])
def test_files(spark, tmp_path, chunk_bytes):
    rows = []
    for name, data in {**CASES, "empty": b""}.items():
        path = tmp_path / f"{name}.txt"
        path.write_bytes(data)
        rows.append((str(path), len(data)))
    rows.append((str(tmp_path / "gone.txt"), 10))
    found = {r.path.rsplit("/", 1)[1]: r for r in whole_encodings(spark.createDataFrame(rows, "path string, size bigint"), chunk_bytes).collect()}
    for name in CASES:
        assert found[f"{name}.txt"].encoding == {"cut": "cp1252"}.get(name, name)
    assert found["empty.txt"].encoding == "ascii"
    assert found["gone.txt"].encoding is None and found["gone.txt"].error


def test_profile_of_a_file_whose_umlaut_comes_late(spark, tmp_path):
    (tmp_path / "late.csv").write_bytes(("id,name\n" + "".join(f"{i},plain\n" for i in range(9000)) + "9000,Größe\n").encode("cp1252"))
    (tmp_path / "plain.csv").write_bytes(("id,name\n" + "".join(f"{i},plain\n" for i in range(9000))).encode())
    got = {r.name: r for r in profile_location(spark, str(tmp_path)).collect()}
    assert (got["late.csv"].encoding, got["late.csv"].encoding_confidence) == ("cp1252", 50)
    assert (got["plain.csv"].encoding, got["plain.csv"].encoding_confidence) == ("ascii", 100)
