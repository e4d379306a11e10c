import os
import re
import sys

sys.path.insert(0, os.path.dirname(__file__))

from helpers import awkward, empty, table  # noqa: E402

from lakeprofile.llm.decontaminate import contamination, drop_contaminated  # noqa: E402

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "one"), (3, "two, three"), (4, None), (5, " .,;"),
         (6, "a b a b a b a b a b a b"), (2, "one"), (10, "élan vital of the time"), (None, "null item words here")]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = {}
    for doc, text in docs:
        have, hit, found = words(text), set(), set()
        for item, passage in items:
            need = words(passage)
            size = min(window, len(need))
            for start in range(len(need) - size + 1 if size else 0):
                for at in range(len(have) - size + 1):
                    if have[at: at + size] == need[start: start + size]:
                        hit.update(range(at, at + size))
                        found.add(str(item)) if item is not None else None
        out[doc] = (len(have), len(hit), sorted(found))
    return out


def items_table(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_against_brute_force(spark):
    docs = [(1, "say ALPHA beta. gamma-delta epsilon zeta eta theta iota kappa lambda end"), (2, "Alpha beta gamma delta epsilon zeta eta theta iota"),
            (3, "a b " * 9), (4, "some one there"), (5, "two three two. Three"), (6, None), (7, ""), (8, "Élan vital of the time"),
            (9, "élan vital of the time, two three"), (10, "b a b a b a b a b a b")]
    got = {r.id: (r.n_words, r.n_hit, r["items"]) for r in contamination(table(spark, docs), items_table(spark)).collect()}
    assert got == brute(docs, ITEMS)


def test_a_passage_in_very_many_documents(spark):
    docs = [(i, f"w{i} alpha beta gamma delta epsilon zeta eta theta iota kappa v{i}") for i in range(300)] + [(1000, "clean words only")]
    got = {r.id: (r.n_words, r.n_hit, r["items"]) for r in contamination(table(spark, docs), items_table(spark)).collect()}
    assert got == brute(docs, ITEMS)
    assert [r.doc_id for r in drop_contaminated(table(spark, docs), items_table(spark)).collect()] == [1000]


def test_awkward_rows_and_empty_tables(spark):
    got = contamination(awkward(spark), items_table(spark)).collect()
    assert len(got) == 14
    assert all(r.n_hit == 3 for r in got if r.id == 6) and sum(r.id == 6 for r in got) == 2
    assert {(r.id, r.n_words) for r in got if r.id in (1, 2, 3)} == {(1, 0), (2, 0), (3, 0)}
    assert contamination(empty(spark), items_table(spark)).count() == 0
    none = contamination(awkward(spark), items_table(spark, [(4, None), (5, "!")])).collect()
    assert len(none) == 14 and all(r.n_hit == 0 and r["items"] == [] for r in none)
    assert drop_contaminated(awkward(spark), items_table(spark)).columns == awkward(spark).columns


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    items = items_table(spark, [(1, "one two three four five six")])
    docs = [(1, "one two three z z z"), (1, "z z z four five six"), (2, "two three four and three four five"), (3, "so one two three four five six it is"), (3, "clean"),
            (None, "one two three"), (None, "four five six"), (None, "one two three four five six")]
    got = sorted((str(r.id), r.n_words, r.n_hit) for r in contamination(table(spark, docs), items).collect())
    assert got == sorted([("1", 6, 0), ("1", 6, 0), ("2", 7, 0), ("3", 9, 6), ("3", 1, 0), ("None", 3, 0), ("None", 3, 0), ("None", 6, 6)])
    kept = sorted((str(r.doc_id), r.text) for r in drop_contaminated(table(spark, docs), items).collect())
    assert kept == sorted((str(i), t) for i, t in docs if "one two three four five six" not in t)
