"""Counts over byte ranges against the standard library's readers."""

import csv
import io
import random

from hypothesis import given, settings, strategies as st

from lakeprofile.sources.chunks import (
    RECORD_START, chunk_outcomes, line_counts, line_ends, lines_of_range, read_lines, record_counts,
)
from lakeprofile.sources.storage import Storage

PIECES = ["a", '"', ",", "\n", "\r", "\r\n", '""', 'b"', '",', "é"]
texts = st.lists(st.sampled_from(PIECES), max_size=40).map("".join)
steps = st.sampled_from([1, 2, 3, 5, 8, 1000])


def records_by_chunks(data: bytes, step: int, delimiter: bytes = b",") -> int:
    state, total = RECORD_START, 0
    for offset in range(0, max(len(data), 1), step):
        lead = data[max(0, offset - 4):offset]
        state, ended = (outcomes := chunk_outcomes(lead, data[offset:offset + step], delimiter))[state][0], \
            outcomes[state][1]
        total += ended
    return total + (state != RECORD_START)


@settings(max_examples=1500, deadline=None)
@given(texts, steps)
def test_records_match_the_csv_reader(text, step):
    expected = sum(1 for _ in csv.reader(io.StringIO(text, newline="")))
    assert records_by_chunks(text.encode(), step) == expected


@settings(max_examples=800, deadline=None)
@given(texts, steps)
def test_lines_match_universal_newlines(text, step):
    data = text.encode()
    found = sum(len(line_ends(data[max(0, at - 4):at], data[at:at + step])) for at in range(0, len(data), step))
    found += bool(data) and data[-1] not in b"\r\n"
    assert found == sum(1 for _ in io.StringIO(text, newline=None))


def test_lines_of_ranges_rebuild_the_file(tmp_path):
    picker = random.Random(3)
    storage = Storage()
    for number in range(150):
        text = "".join(picker.choice(["a", "é", "\n", "\r", "\r\n", "bb"]) for _ in range(picker.randint(0, 24)))
        for encoding in ("utf-8", "utf-16", "utf-8-sig"):
            path = tmp_path / f"{number}-{encoding}"
            path.write_bytes(text.encode(encoding))
            size, step = path.stat().st_size, picker.choice([4, 8, 12, 100])
            found = [line for at in range(0, max(size, 1), step)
                     for line in lines_of_range(storage, str(path), encoding, at, step, 1000)]
            assert found == [line.rstrip("\n") for line in io.StringIO(text, newline=None)]


def test_a_line_over_the_limit_is_reported(tmp_path):
    path = tmp_path / "long.jsonl"
    path.write_text("short\n" + "x" * 5000 + "\nend\n")
    found = list(lines_of_range(Storage(), str(path), "utf-8", 0, 10_000, 100))
    assert found[0] == "short" and None in found


def test_counts_through_spark_in_tiny_chunks(files_of, tmp_path, monkeypatch):
    # Few chunks per block, so that both levels of joining are at work.
    monkeypatch.setattr("lakeprofile.sources.chunks.CHUNKS_PER_BLOCK", 3)
    texts = {
        "quoted.csv": 'id,note\n1,"two\nlines, ""quoted"""\n\n2,plain\n',
        "open.csv": 'a,b\n1,"never closed\n2,3\n',
        "stray.csv": 'size,name\n5" pipe,x\n6" pipe,y',
        "crlf.csv": "a,b\r\n1,2\r\n3,4\r\n",
        "empty.csv": "",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    files = files_of([tmp_path / name for name in texts])
    expected_records = {name: sum(1 for _ in csv.reader(io.StringIO(text, newline=""))) for name, text in texts.items()}
    expected_lines = {name: sum(1 for _ in io.StringIO(text, newline=None)) for name, text in texts.items()}
    for chunk in (4, 8, 1 << 20):
        found = {row.path.split("/")[-1]: row.records for row in record_counts(files, chunk).collect()}
        assert found == expected_records
        found = {row.path.split("/")[-1]: row.row_count for row in line_counts(files, chunk).collect()}
        assert found == expected_lines


def test_wide_encodings_and_missing_files(files_of, spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_bytes('a,b\n"x\ny",2\nж,4\n'.encode("utf-16"))
    assert record_counts(files_of([path], "utf-16"), 8).first().records == 3
    assert line_counts(files_of([path], "utf-16"), 8).first().row_count == 4
    gone = spark.createDataFrame([("/not/there", 10, "utf-8", ",")],
                                 "path string, size bigint, encoding string, delimiter string")
    row = record_counts(gone).first()
    assert row.records is None and "there" in row.error


def test_read_lines_keeps_order_and_text(files_of, tmp_path):
    path = tmp_path / "lines.txt"
    lines = [f"line {n} {'x' * (n % 7)}" for n in range(500)]
    path.write_text("\n".join(lines))
    found = read_lines(files_of([path]), 64).orderBy("chunk", "number").collect()
    assert [row.line for row in found] == lines
