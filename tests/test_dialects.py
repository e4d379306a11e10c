"""Delimiters told from every record, against a reading of the whole text."""

from collections import Counter

import pytest
from hypothesis import given, strategies as st

from lakeprofile.plans.profile import profile_location
from lakeprofile.sources.delimited import DELIMITERS
from lakeprofile.sources.dialects import HEAD, TAIL, WHOLE, field_counts, range_histogram, whole_dialects


def walked(data: bytes) -> Counter:
    """Records by delimiter and field count, one byte after the other."""
    counts, quoted, filled, held = Counter(), False, False, Counter()
    for byte in [*data, 10] if data.count(b'"') % 2 == 0 else data:
        quoted ^= byte == 34
        if byte in (10, 13) and not quoted:
            if filled:
                counts.update({(delimiter, held[delimiter] + 1): 1 for delimiter in DELIMITERS})
            filled, held = False, Counter()
            continue
        filled |= byte not in b"\t\n\v\f\r "
        if not quoted:
            held[chr(byte)] += 1
    if filled:
        counts.update({(delimiter, held[delimiter] + 1): 1 for delimiter in DELIMITERS})
    return counts


PIECES = st.lists(st.sampled_from([b"a", b",", b";", b"|", b"\t", b":", b'"', b"\n", b"\r\n", b"\r", b" ", "é".encode()]), max_size=60).map(b"".join)


@given(PIECES, st.integers(1, 9))
def test_ranges_add_up(data, step):
    counts, inside, record, pieces = Counter(), False, 0, {}
    for start in range(0, max(len(data), 1), step):
        part = data[start: start + step]
        rows = range_histogram(part, inside)
        for piece, delimiter, n, filled, times in rows:
            if piece == WHOLE:
                counts[delimiter, n + 1] += times
            else:
                key = record + (piece == TAIL), delimiter
                before = pieces.get(key, (0, False))
                pieces[key] = before[0] + n, before[1] or filled
        record += any(piece == TAIL for piece, *_ in rows)
        inside ^= part.count(b'"') % 2 == 1
    counts.update({(delimiter, n + 1): 0 for (_, delimiter), (n, _) in pieces.items()})
    for (_, delimiter), (n, filled) in pieces.items():
        counts[delimiter, n + 1] += filled
    assert +counts == walked(data)
    assert HEAD == 0


FILES = {
    "quoted.csv": b'x;y\n"a,b\nc,d";2\n' * 40,
    "long.csv": b"p|q|" + b"n," * 3000 + b"|r\n" + b"1|2|3|4\n" * 30,
    "blank.csv": b"\n \n\r\n",
    "empty.csv": b"",
    "open.csv": b"a,b\n1,2\n3,4",
    "wide.csv": "a\tb\n1\t2\n".encode("utf-16"),
    "mixed.csv": b"a,b\nc;d\n",
}
TOLD = {"quoted.csv": ";", "long.csv": "|", "open.csv": ",", "wide.csv": "\t", "mixed.csv": None}


@pytest.mark.parametrize("chunk_bytes", [4, 64, 1 << 20])
def test_files(spark, tmp_path, files_of, chunk_bytes):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    rows = spark.createDataFrame([(str(tmp_path / name), len(data), "utf-16" if name == "wide.csv" else "utf-8") for name, data in FILES.items()]
                                 + [(str(tmp_path / "gone.csv"), 5, "utf-8")], "path string, size bigint, encoding string")
    found = {row.path.rsplit("/", 1)[1]: row.told for row in whole_dialects(rows, chunk_bytes).collect()}
    assert found == TOLD
    counts = Counter()
    for row in field_counts(rows, chunk_bytes).filter("path like '%quoted.csv' or path like '%open.csv'").collect():
        counts[row.path.rsplit("/", 1)[1], row.delimiter, row.fields] = row.records
    assert counts == Counter({(name, *key): n for name in ("quoted.csv", "open.csv") for key, n in walked(FILES[name]).items()})


def test_profiles_of_files_whose_heads_mislead(spark, tmp_path):
    (tmp_path / "preamble.csv").write_text(("a, b, c, " * 30 + "\n") * 20 + "1;2\n" * 500)
    (tmp_path / "header.csv").write_text("|".join(f"name, of; column {n}" for n in range(400)) + "\n" + ("|".join("1" * 400) + "\n") * 50)
    found = {row.name: row for row in profile_location(spark, str(tmp_path)).collect()}
    assert found["preamble.csv"].delimiter == ";"
    assert found["header.csv"].delimiter == "|" and found["header.csv"].has_header
    assert found["header.csv"].column_count == 400 and found["header.csv"].row_count == 50
    assert {column.detected_type for column in found["header.csv"].columns} == {"int64"}
