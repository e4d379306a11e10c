"""Parts of delimited files against a reader of the whole."""

import csv
import io

import pytest
from hypothesis import given, strategies as st

from lakeprofile.sources.chunks import RECORD_START, chunk_outcomes
from lakeprofile.sources.splitting import first_record_start, record_parts, split_delimited

TEXTS = st.text(alphabet='a",\n\r', max_size=40)


def record_starts(data: bytes) -> list[int]:
    """Byte by byte."""
    starts, state, at = [0] if data else [], RECORD_START, 0
    while at < len(data):
        size = 2 if data[at: at + 2] == b"\r\n" else 1
        state = chunk_outcomes(b"", data[at: at + size], b",")[state][0]
        at += size
        if state == RECORD_START and at < len(data) and data[at - 1: at] in (b"\n", b"\r"):
            starts.append(at)
    return starts


@given(TEXTS, st.integers(1, 12))
def test_first_starts_of_chunks_are_record_starts(text, size):
    data = text.encode()
    state, found = RECORD_START, []
    for offset in range(0, len(data), size):
        lead, chunk = data[max(0, offset - 4): offset], data[offset: offset + size]
        first = first_record_start(lead, chunk, b",", state)
        found.append(None if first is None else offset + first)
        state = chunk_outcomes(lead, chunk, b",")[state][0]
    starts = record_starts(data)
    assert found == [next((s for s in starts if offset <= s < offset + size), None) for offset in range(0, len(data), size)]


ROWS = [["id", "te\nxt"]] + [[str(i), ['plain', 'with "quotes"', "two\nlines", "a,b", "", "\r\n" * (i % 5)][i % 6]] for i in range(200)]


def rendered(**options) -> bytes:
    out = io.StringIO(newline="")
    csv.writer(out, **options).writerows(ROWS)
    return out.getvalue().encode()


FILES = {"a.csv": rendered(), "b.csv": rendered(lineterminator="\n", quoting=csv.QUOTE_ALL), "c.csv": b"\xef\xbb\xbf" + rendered(lineterminator="\r"),
         "long.csv": b'id,t\n1,"' + b"x\n" * 3000 + b'"\n2,y\n', "none.csv": b"", "noend.csv": b"id,t\n1,2"}


@pytest.mark.parametrize("part_bytes", [64, 1000])
def test_parts_are_the_file(spark, tmp_path, part_bytes):
    (tmp_path / "in").mkdir()
    rows = []
    for name, data in FILES.items():
        (tmp_path / "in" / name).write_bytes(data)
        rows.append((str(tmp_path / "in" / name), len(data), "utf-8-sig" if data[:1] == b"\xef" else "utf-8", ",", True))
    rows.append((str(tmp_path / "in" / "wide.csv"), 10, "utf-16", ",", True))
    (tmp_path / "in" / "wide.csv").write_bytes("id,t\n".encode("utf-16"))
    files = spark.createDataFrame(rows, "path string, size bigint, encoding string, delimiter string, has_header boolean")
    cuts, ranges = {}, {}
    for r in record_parts(files, part_bytes).filter("error IS NULL").collect():
        ranges.setdefault(r.path.rsplit("/", 1)[1], []).append((r.begin, r.end))
    for r in split_delimited(files, str(tmp_path / "out"), part_bytes).collect():
        cuts.setdefault(r.path.rsplit("/", 1)[1], []).append((r.part, r.written, r.error))
    assert cuts.pop("wide.csv")[0][2]
    for name, data in FILES.items():
        spans = sorted(ranges.get(name, []))
        assert b"".join(data[a:b] for a, b in spans) == data
        if not data:
            continue
        mark = 3 if data[:1] == b"\xef" else 0
        whole = list(csv.reader(io.StringIO(data[mark:].decode(), newline="")))
        read = [list(csv.reader(io.StringIO(open(written, "rb").read().decode("utf-8-sig"), newline=""))) for _, written, _ in sorted(cuts[name])]
        assert [row for part in read for row in part[1:]] == whole[1:] and all(part[0] == whole[0] for part in read)
        assert len(read) > 1 or len(data) <= part_bytes or name in ("long.csv", "noend.csv")
