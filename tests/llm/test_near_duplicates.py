import os
import random
import re
import sys

sys.path.insert(0, os.path.dirname(__file__))

from helpers import awkward, empty, table  # noqa: E402

from lakeprofile.llm.common import connected  # noqa: E402
from lakeprofile.llm.near_duplicates import drop_near_duplicates, near_duplicate_groups  # noqa: E402


def brute(rows, width, percent=80):
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        size = min(width, len(words))
        sets[doc] = {tuple(words[i: i + size]) for i in range(len(words) - size + 1)} if words else set()
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {doc: (len(sets[doc]), root(doc)) for doc in docs}


def edited(source, words, edits):
    words = list(words)
    for _ in range(edits):
        words[source.randrange(len(words))] = f"e{source.randrange(40)}"
    return " ".join(words)


def test_a_large_group_at_all_distances(spark):
    source = random.Random(7)
    base = [f"w{source.randrange(3000)}" for _ in range(150)]
    rows = [(1000 - i, edited(source, base, source.randrange(0, 14))) for i in range(220)]
    rows += [(2000 + i, edited(source, [f"v{source.randrange(500)}" for _ in range(60)], 0)) for i in range(40)]
    rows += [(3000 + i, " ".join(base)) for i in range(30)]
    got = {r.id: (r.n_shingles, r.component) for r in near_duplicate_groups(table(spark, rows), width=4).collect()}
    assert got == brute(rows, 4)


def test_chains_reach_the_smallest_id(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(50 - i, " ".join(words[4 * i: 4 * i + 60])) for i in range(12)]
    got = {r.id: (r.n_shingles, r.component) for r in near_duplicate_groups(table(spark, rows), width=5).collect()}
    assert got == brute(rows, 5)
    assert {component for _, component in got.values()} == {min(got)}


def test_awkward_rows(spark):
    got = near_duplicate_groups(awkward(spark), width=4).collect()
    assert len(got) == 14
    by_id = {r.id: r for r in got}
    assert by_id[1].n_shingles == 0 and by_id[1].component == 1 and by_id[2].component == 2 and by_id[3].kept
    assert (by_id[4].component, by_id[5].component, by_id[5].kept) == (4, 4, False)
    assert by_id[8].component == 7
    assert all(r.kept and r.component is None for r in got if r.id is None)
    kept = drop_near_duplicates(awkward(spark))
    assert kept.columns == awkward(spark).columns and {5, 8}.isdisjoint(r.doc_id for r in kept.collect())
    assert near_duplicate_groups(empty(spark)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i + 1, i) for i in range(100, 140)] + [(500, i) for i in range(501, 700)] + [(3, 3)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(500, 700)} == {500} and 3 not in got
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
