import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

sys.path.insert(0, os.path.dirname(__file__))

from helpers import awkward, empty, table  # noqa: E402

from lakeprofile.llm import repeats  # noqa: E402
from lakeprofile.llm.repeats import anchors, merged, without_repeats  # noqa: E402
from lakeprofile.llm.suffixes import suffix_array  # noqa: E402


def brute(rows, length=50):
    first, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            string = data[at: at + length]
            if first.setdefault(string, doc) < doc:
                gone[at: at + length] = b"\x01" * length
        out[doc] = (len(data), sum(gone), sum(1 for run in bytes(gone).split(b"\x00") if run), bytes(c for c, g in zip(data, gone) if not g))
    return out


@given(st.binary(max_size=60) | st.text("ab", max_size=60).map(str.encode))
@settings(max_examples=300, deadline=None)
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_repetitions():
    for text in (b"a" * 500, b"ab" * 300, b"aab" * 200 + b"b", b"\x00\xff" * 100):
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_every_string_has_one_anchor_and_equal_strings_the_same():
    source = random.Random(3)
    shared = bytes(source.choices(range(97, 101), k=90))
    one = bytes(source.choices(range(97, 101), k=300)) + shared + b"tail" * 20
    two = b"z" * 77 + shared + bytes(source.choices(range(97, 123), k=100))
    named = []
    for data in (one, two):
        hashes, at, first, last = anchors(np.frombuffer(data, np.uint8))
        assert sum(last - first + 1) == len(data) - 49
        named.append({data[p: p + 50]: (h, a - p) for h, a, f, e in zip(hashes, at, first, last) for p in range(f, e + 1)})
    both = set(named[0]) & set(named[1])
    assert len(both) >= 41 and all(named[0][s] == named[1][s] for s in both)


def rows_with_repeats():
    source = random.Random(11)
    word = lambda: "".join(source.choices("abcdeé", k=source.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (9, 14, 60, 200)]
    rows = []
    for doc in range(120):
        parts = [" ".join(word() for _ in range(source.randrange(1, 40))) for _ in range(4)]
        rows.append((500 - doc, "".join(p + (source.choice(passages) if source.random() < 0.5 else " ") for p in parts)))
    rows += [(source.randrange(1000, 2000), rows[k % 7][1]) for k in range(30)]
    rows += [(3000, "ab" * 200), (3001, "x" + "ab" * 150), (3002, "q" * 49), (3003, "q" * 50), (3004, "q" * 51), (3005, None), (3006, "")]
    return list({doc: (doc, text) for doc, text in rows}.values())


@pytest.mark.parametrize("hot", [20_000, 5])
def test_against_brute_force(spark, hot):
    rows = rows_with_repeats()
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in without_repeats(table(spark, rows), hot=hot).collect()}
    assert got == brute(rows)


def test_occurrences_count_where_few_documents_repeat_a_line_often(spark, monkeypatch):
    taken = []
    by_common = repeats._covered_by_common
    monkeypatch.setattr(repeats, "_covered_by_common", lambda *args: taken.append(1) or by_common(*args))
    line = "2026-12-01 12:00:00 INFO the same header line of a long log file stands here again\n"
    rows = [(doc, "".join(f"{line}{doc * 1000 + i}\n" for i in range(200))) for doc in (7, 3, 5)] + [(9, "nothing in common " * 3)]
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in without_repeats(table(spark, rows), hot=100).collect()}
    assert taken and got == brute(rows)


def test_stretches_of_a_long_text_come_in_small_batches(monkeypatch):
    text = "".join(f"header line number one of many {i % 50} and some more words\n" for i in range(20_000))
    wanted = np.unique(anchors(np.frombuffer(text.encode(), np.uint8))[0]).view(np.int64)
    batch = pa.RecordBatch.from_pydict({"id": [1], "version": [2], "text": [text], "anchors": pa.array([wanted], pa.list_(pa.int64()))})
    made = [out.num_rows for out in repeats._stretches(50, 26)(iter([batch]))]
    assert sum(made) > 20_000 and max(made) <= 20_000


def test_spans_merge():
    starts, ends = merged(np.array([5, 0, 3, 20, 30]), np.array([9, 4, 6, 30, 31]))
    assert list(zip(starts, ends)) == [(0, 9), (20, 31)]
    assert len(merged(np.array([], int), np.array([], int))[0]) == 0


def test_awkward_rows(spark):
    got = without_repeats(awkward(spark)).collect()
    assert len(got) == 14
    by_id = {r.id: r for r in got}
    assert by_id[1].n_bytes == by_id[2].n_bytes == 0 and by_id[8].n_removed == by_id[7].n_bytes and bytes(by_id[8].kept) == b"!"
    assert all(r.n_removed == 0 for r in got if r.id in (None, 6, 9))
    assert without_repeats(empty(spark)).count() == 0


def test_anchors_of_texts_in_a_row_are_those_of_each():
    source = random.Random(5)
    texts = ["".join(source.choices("abcd é", k=source.choice([0, 10, 49, 50, 51, 300]))).encode() for _ in range(60)]
    ends = np.cumsum([len(text) for text in texts])
    together = list(zip(*(column.tolist() for column in anchors(np.frombuffer(b"".join(texts), np.uint8), ends=ends))))
    alone = []
    for text, end in zip(texts, ends.tolist()):
        begin = end - len(text)
        alone += [(h, a + begin, f + begin, e + begin) for h, a, f, e in zip(*(c.tolist() for c in anchors(np.frombuffer(text, np.uint8))))]
    assert together == alone


def test_anchors_are_followed_whatever_the_batches():
    source = random.Random(8)
    for _ in range(200):
        parts = [[(source.randrange(6), source.randrange(8)) for _ in range(source.randrange(1, 12))] for _ in range(4)]
        rows, holders, times = [], {}, {}
        for part in parts:
            for anchor in sorted({a for a, _ in part}):
                docs = [d for a, d in part if a == anchor]
                ids = list(dict.fromkeys(docs))
                rows += [(ids[0], anchor, 2 * len(docs) + (len(ids) > 1))] + [(d, anchor, 0) for d in ids[1:]]
                holders.setdefault(anchor, set()).update(docs)
                times[anchor] = times.get(anchor, 0) + len(docs)
        rows.sort(key=lambda row: row[1])
        size = source.randrange(1, 9)
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k: k + size])], ["id", "anchor", "n"]) for k in range(0, len(rows), size)]
        got = [(r["id"], r["anchor"]) for out in repeats._followed(6)(iter(batches)) for r in out.to_pylist()]
        assert {row for row in got if row[0] is not None} == {(d, a) for a, docs in holders.items() if len(docs) > 1 for d in docs}
        assert {a for d, a in got if d is None} == {a for a, n in times.items() if n > 6 and len(holders[a]) > 1}


def test_whole_copies_and_repeated_ids(spark):
    text = "a text that stands in several documents as it is, from its first to its last byte. " * 3
    rows = [(4, text), (2, text), (9, text), (3, "before it " + text), (5, "short"), (6, "short")]
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in without_repeats(table(spark, rows)).collect()}
    assert got == brute(rows)
    again = without_repeats(table(spark, [(4, text), (4, text), (4, "other words, other words, other words, other words, other words"), (7, text)])).collect()
    assert sorted((r.id, r.n_removed) for r in again) == [(4, 0), (4, 0), (4, 0), (7, len(text))]


def test_suffix_array_of_symbols_beyond_bytes():
    source = random.Random(2)
    for _ in range(200):
        text = "".join(source.choices("ab\x00Ā", k=source.randrange(60)))
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_strings_of_stretches_and_what_is_sorted_of_them(monkeypatch):
    sorted_ = []
    by_suffixes = repeats.suffix_array
    monkeypatch.setattr(repeats, "suffix_array", lambda text: sorted_.append(len(text)) or by_suffixes(text))
    source = random.Random(6)
    for length, seed in ((50, 26), (13, 6), (12, 11)):
        for _ in range(60):
            anchor, stretches = bytes(source.choices(range(256), k=seed)), {}
            for _ in range(source.randrange(1, 9)):
                lead, behind = source.randrange(length - seed + 1), source.randrange(length - seed + 1)
                behind = max(behind, length - seed - lead)
                side = lambda n: bytes(source.choices(b"\x00aa\xff", (1, 20, 20, 1), k=n))
                whole = b"a" * 30 if source.random() < 0.7 else side(30)
                stretches[lead, (whole + side(3))[-lead:] * (lead > 0) + anchor + (side(1) + whole)[:behind]] = source.randrange(-4, 50)
            least = {}
            for (_, bytes_), id_ in stretches.items():
                for at in range(len(bytes_) - length + 1):
                    least[bytes_[at: at + length]] = min(id_, least.get(bytes_[at: at + length], id_))
            sorted_.clear()
            got = repeats.first_documents(stretches, length, seed)
            assert got == {s: [least[s[1][at: at + length]] for at in range(len(s[1]) - length + 1)] for s in stretches}
            # The anchor is one symbol, and one more ends each stretch.
            assert sum(sorted_) <= sum(len(bytes_) - seed + 2 for _, bytes_ in stretches)


def test_texts_are_shuffled_once_whatever_is_very_common(spark, tmp_path):
    line = "2026-12-01 12:00:00 INFO the same header line of a long log file stands here again\n"
    rows = [(doc, "".join(f"{line}{doc * 1000 + i}\n" for i in range(200))) for doc in (7, 3, 5)]
    written = []
    keep = repeats.write_and_read
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(repeats, "write_and_read", lambda df, label: written.append(label) or keep(df, label))
        found = without_repeats(table(spark, rows), hot=100)
    assert written == ["copies", "followed", "very_common"]
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()}
    assert got == brute(rows)
    # Every reader of the stretches has the same shuffle before it, so that Spark makes one of them.
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("REPARTITION_BY_COL") > 1 and final.count("MapInArrow") == 2 and "ReusedExchange" in final
