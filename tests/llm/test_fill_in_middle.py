import sys, os  # noqa: E401

sys.path.insert(0, os.path.dirname(__file__))

import hashlib  # noqa: E402

from helpers import AWKWARD, awkward, empty, table  # noqa: E402
from hypothesis import given, strategies as st  # noqa: E402

from lakeprofile.llm import fill_in_middle as fim  # noqa: E402


def brute(doc, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i: i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not n or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(spark, rows, docs):
    done = fim.fill_in_middle(docs)
    done = done.withColumns({"back": fim.restored_text(done.output, done.form), "back_sha256": fim.restored_sha256(done.output, done.form)})
    got = done.collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=key) == sorted(
        ((doc, *brute(doc, text), text or "") for doc, text in rows), key=key)
    for r in got:
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        assert r.back_sha256 == hashlib.sha256(r.back.encode()).hexdigest()
    return got


def test_same_as_brute_force(spark):
    rows = [(i, "aé漢\U0001f600<S" * (i % 9) + "P>"[: i % 3]) for i in range(300)] + [(400, "x<P>y"), (401, "<M>"), (402, "<<S>"), (403, "< P>")]
    got = check(spark, rows, table(spark, rows))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_awkward_rows(spark):
    check(spark, [(row[0], row[1]) for row in AWKWARD], awkward(spark))


def test_empty_table(spark):
    assert fim.fill_in_middle(empty(spark)).count() == 0


@given(st.text(alphabet="a<PSM>é漢\U0001f600\0\n", max_size=40), st.integers(0, 2**32), st.integers(0, 2**32), st.integers(0, 99))
def test_pieces_restore_the_document(text, h1, h2, h4):
    data = memoryview(text.encode())
    n, form, prefix, middle, pieces = fim.rearrange(data, (h1, h2, 0, h4))
    output = b"".join(fim.stream((data, memoryview(fim.SENTINELS)), pieces))
    assert n == len(text)
    assert b"".join(fim.stream((memoryview(output),), fim.restored(memoryview(output), form))) == data
    assert fim.digest((data, memoryview(fim.SENTINELS)), pieces) == hashlib.sha256(output).hexdigest()
    if form != "plain":
        assert output.decode().endswith("<M>" + text[prefix: prefix + middle])


def test_offsets_cross_the_counting_steps(monkeypatch):
    monkeypatch.setattr(fim, "_STEP", 5)
    text = "aé漢\U0001f600b" * 7
    data = fim.np.frombuffer(text.encode(), fim.np.uint8)
    counts = fim.code_points(data)
    assert [fim.byte_offset(data, counts, i) for i in range(len(text) + 1)] == [len(text[:i].encode()) for i in range(len(text) + 1)]


def test_inverse_permutation():
    for order in fim.ORDERS.values():
        assert fim.arranged(fim.arranged("abcdef", order), fim.inverse(order)) == list("abcdef")
