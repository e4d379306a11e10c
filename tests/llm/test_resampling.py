import sys, os  # noqa: E401

sys.path.insert(0, os.path.dirname(__file__))

import hashlib  # noqa: E402
import math  # noqa: E402
import re  # noqa: E402
import zlib  # noqa: E402
from collections import Counter  # noqa: E402

import pytest  # noqa: E402
from helpers import AWKWARD, awkward, empty, table  # noqa: E402
from hypothesis import given, strategies as st  # noqa: E402

from lakeprofile.llm import resampling  # noqa: E402
from lakeprofile.llm.resampling import resample  # noqa: E402


def features(text, low, high):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return words, [" ".join(words[i: i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, ngrams=(1, 1), min_words=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    split = [(doc, *features(text, *ngrams)) for doc, text in docs]
    s = Counter(bucket(f) for _, _, found in split for f in found)
    t = Counter(bucket(f) for text in target for f in features(text, *ngrams)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * float(all_s + buckets) / ((s[b] + 1) * float(all_t + buckets)))) for b in s}
    rows = []
    for doc, words, found in split:
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    eligible = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for place, row in enumerate(eligible, 1):
        row[4] = place if place <= percent * len(eligible) // 100 else None
    return [tuple(r[:4]) + (r[4] if any(r is e for e in eligible) else None,) for r in rows]


def key(row):
    return tuple(map(str, row))


def same(spark, docs, target, **settings):
    got = resample(table(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), **settings)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, target, **settings), key=key)


DOCS = [(i, " ".join(f"W{i * 31 % 17}x{j * i % 23} É{j % 5}" for j in range(i % 40))) for i in range(500)]
TARGET = ["w3x1 é2 É2 unheard", None, "", "w4x1 w5x2"] * 5


@pytest.mark.parametrize("settings", [{}, {"ngrams": (1, 2)}, {"percent": 100, "min_words": 0}, {"percent": 37, "buckets": 50}, {"percent": 0}])
def test_same_as_brute_force(spark, settings):
    same(spark, DOCS, TARGET, **settings)


def test_ties_go_to_the_smaller_id(spark):
    # Scores are whole numbers: of so many rows of one weight, many are tied, and cuts at every share fall among them.
    docs = [(i, "same words again " * 10) for i in range(3000)]
    rows = brute(docs, ["same"])
    scores = Counter(r[3] for r in rows)
    cuts = [k for k in range(1, 100) if scores[sorted((r[3] for r in rows), reverse=True)[k * 30 - 1]] > 2][:2]
    assert cuts
    for percent in cuts:
        same(spark, docs, ["same"], percent=percent)


def test_rows_that_repeat_an_id(spark):
    docs = [(7, "a b c d " * 10)] * 90 + [(8, "a b c e " * 10)] * 10 + [(None, "a b c d " * 10)] * 3
    got = resample(table(spark, docs), spark.createDataFrame([("a",)], "text string"), percent=50).collect()
    assert len(got) == len(docs) and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 52))
    scores = sorted((r.score for r in got), reverse=True)
    assert sorted((r.score for r in got if r["rank"]), reverse=True) == scores[:51]


def test_awkward_rows(spark):
    same(spark, [(row[0], row[1]) for row in AWKWARD], ["a b"], percent=60, min_words=1)
    assert awkward(spark).count() == len(AWKWARD)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resample(empty(spark), none).count() == 0
    same(spark, DOCS[:50], [])


@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60), st.data())
def test_bisection_finds_the_wanted_row(values, data):
    wanted = data.draw(st.integers(1, len(values)))

    class Rows:  # counts as the DataFrame does
        def agg(self, *columns):
            self.asked = columns
            return self

        def first(self):
            return [sum(v <= m for v in values) for m in self.asked]

    class Threshold:
        def __le__(self, middle):
            return middle

    class Functions:
        col = staticmethod(lambda name: Threshold())
        count_if = staticmethod(lambda middle: type("Counted", (int,), {"alias": lambda self, name: self})(middle))

    kept, resampling.F = resampling.F, Functions
    try:
        least, below = resampling._bisect(Rows(), "v", wanted, min(values), max(values))
    finally:
        resampling.F = kept
    assert least == sorted(values)[wanted - 1] and below == sum(v < least for v in values)
