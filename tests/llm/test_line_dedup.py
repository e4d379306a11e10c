import sys, os  # noqa: E401

sys.path.insert(0, os.path.dirname(__file__))

from helpers import AWKWARD, LONG, awkward, empty, table  # noqa: E402

from lakeprofile.llm.line_dedup import dedup_lines  # noqa: E402


def brute(rows):
    """Text by (id, text): the later occurrences of three lines go."""
    first, gone = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        lines = text.split("\n")
        for at in range(len(lines) - 2):
            window = tuple(lines[at: at + 3])
            if not any(line.strip(" \r\t") for line in window):
                continue
            if window in first:
                gone.setdefault(doc, set()).update((at, at + 1, at + 2))
            else:
                first[window] = (doc, at)
    return {doc: "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get(doc, ())) for doc, text in rows}


def test_later_windows_go_and_overlaps_merge(spark):
    rows = [(1, "a\nb\nc\nd\nx"), (2, "q\na\nb\nc\nd\nr"), (3, "a\nb\nz\na\nb\nz\na\nb"), (4, "\n\n\n\n"), (5, "b\nc\nd"), (6, "b\nc")]
    found = {r.doc_id: r for r in dedup_lines(table(spark, rows)).collect()}
    assert {doc: r.text for doc, r in found.items()} == brute(rows)
    assert (found[2].n_lines, found[2].n_removed, found[2].text) == (6, 4, "q\nr")
    assert found[5].text == "" and found[4].n_removed == 0


def test_one_window_in_very_many_documents(spark):
    rows = [(i, f"head {i}\nsame one\nsame two\nsame three\ntail {i}") for i in range(300)]
    assert {r.doc_id: r.text for r in dedup_lines(table(spark, rows)).collect()} == brute(rows)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = dedup_lines(docs)
    assert got.count() == len(AWKWARD)
    assert set(docs.columns) <= set(got.columns) and got.columns.count("n_lines") == 1
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[1].text is None and by_id[1].n_lines == 0
    assert by_id[2].text == "" and by_id[2].n_lines == 1
    assert by_id[7].text == LONG and by_id[8].text == LONG.split("\n")[-1] + "!"
    assert by_id[4].window == "other"


def test_empty_table(spark):
    assert dedup_lines(empty(spark)).count() == 0
