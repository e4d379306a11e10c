import os
import sys
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from helpers import awkward, empty, table  # noqa: E402

from lakeprofile.llm import queries  # noqa: E402
from lakeprofile.llm.language_id import drop_undetermined, learn_languages, model_of, with_language  # noqa: E402
from lakeprofile.llm.nearest import hadamard, nearest_neighbours, rotated  # noqa: E402
from lakeprofile.llm.quality import Network, estimated_prior, features, with_quality  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_languages_of_rows_that_were_held_out(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "lang"]]
    got = queries.op9_language_id(spark, SF).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() >= 0.98
    assert got.score.between(0, 1).all()


def test_backoff_takes_the_longest_known_gram():
    model = model_of({"a": Counter({"xyz": 8, "q": 1}), "b": Counter({"yz": 5})})
    grams = model.grams
    row = lambda gram: grams[len(gram) - 1].get(gram)
    # <xyw>: "<xy" is known, "xyw" isn't but "xy" is, then "y", nothing for "w", and ">".
    assert np.allclose(model.unseen("xyw"), row("<xy") + row("xy") + row("y") + row(">"))
    assert row("<xyz")[0] > row("<xyz")[1] and row("w") is None
    assert model.words.get("xyz")[0] > model.words.get("xyz")[1]
    assert model_of({}).languages == []


def test_unseen_words_look_up_each_rest_once():
    from lakeprofile.llm import language_id

    model = model_of({"a": Counter({"xyz": 8, "q": 1, "zzé": 2}), "b": Counter({"yz": 5})})
    asked, by_length = [], model.longest
    model.longest = lambda rest: asked.append(rest) or by_length(rest)
    scores = language_id._Scores(model)
    words = ["xyw", "xyxyw", "éxyq", "w", "𝒳yz", "xyw", "yzyzyzyz"]
    for word in words:
        marked, total = f"<{word}>", np.zeros(2)
        for at in range(len(marked)):
            known = [row for row in (model.grams[n - 1].get(marked[at: at + n]) for n in range(4, 0, -1) if at + n <= len(marked)) if row is not None]
            total += known[0] if known else 0
        assert (scores.rows[scores[word]] == total.astype(np.float32)).all()
    assert len(asked) == len(set(asked))


def test_language_of_awkward_rows(spark):
    rows = [(i, "the cat and the dog of the house", "en") for i in range(20)] + [(100 + i, "der hund und die katze im haus", "de") for i in range(20)]
    rows += [(300, None, "en"), (301, "", "de"), (302, "12 34 !", "en"), (303, "the haus", None), (None, "der hund", "de"), (304, "Ωμέγα", None), (0, "the cat and the dog of the house", "en")]
    docs = table(spark, rows)
    got = {r.doc_id: r for r in with_language(docs).collect()}
    assert [got[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and got[302].score == 0
    assert got[None].lang_pred == "de" and got[None].held_out
    assert got[5].lang_pred == "en" and got[105].lang_pred == "de" and got[304].lang_pred in ("en", "de")
    kept = drop_undetermined(docs)
    assert kept.columns == docs.columns and {300, 301, 302}.isdisjoint(r.doc_id for r in kept.collect())
    assert with_language(empty(spark)).count() == 0
    unlabelled = table(spark, [(1, "some text", None), (2, None, None)])
    assert {r.lang_pred for r in with_language(unlabelled).collect()} == {"und"}


def test_quality_of_rows_that_were_held_out(spark):
    labels = pd.read_parquet("/root/testdata/sf0.1/labels.parquet")
    got = queries.op3_quality(spark, "/root/testdata/sf0.1").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    held = got.merge(labels, on="doc_id")
    held = held[held.held_out]
    assert (held.predicted == held.quality).mean() >= 0.97


def test_positive_unlabelled_risk_finds_the_bad_among_the_unlabelled():
    source = np.random.default_rng(5)
    good, bad = source.normal(0, 1, (1200, 4)), source.normal(2.5, 1, (300, 4))
    network = Network(4)
    network.train(good[:400], np.concatenate([good[400:], bad[:200]]), 0.8)
    assert (network.score(good) >= 0.5).mean() > 0.9 and (network.score(bad[200:]) < 0.5).mean() > 0.9


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_the_prior_comes_from_good_and_unlabelled_texts(share):
    source = np.random.default_rng(5)
    drawn = lambda n, at: source.normal(at, 1, (n, 3))
    unlabelled = np.concatenate([drawn(int(8000 * share), 2), drawn(int(8000 * (1 - share)), -2)])
    source.shuffle(unlabelled)
    assert abs(estimated_prior(drawn(4000, 2), unlabelled) - share) < 0.03
    assert estimated_prior(drawn(1, 2), unlabelled) == 0.5


def test_every_language_is_learned(spark):
    names = [f"l{n:03}" for n in range(520)]
    docs = spark.createDataFrame([(n, f"wort{name} {name}", name) for n, name in enumerate(names)], "doc_id long, text string, lang string")
    assert learn_languages(docs).languages == names


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(4, 1), (7, 1), (8, 0), (9, None), (None, 1), (4, 0), (77, 1)], "doc_id long, quality int")
    got = with_quality(docs, labels)
    assert got.count() == 14 and got.columns.count("score") == 1
    assert all(0 <= r.score <= 1 for r in got.collect())
    none = with_quality(docs, labels.filter("false"))
    assert {r.score for r in none.collect()} == {0.5}
    assert with_quality(empty(spark), labels).count() == 0
    assert len({len(features(np.frombuffer(x, np.uint8))) for x in (b"", b" ", b"a", b"a\n\nb", "é".encode() * 5000)}) == 1


def exact(vectors, query, k=10):
    rows = [(float(np.sqrt(((np.array(v, float) - np.array(vectors[query], float)) ** 2).sum())), i) for i, v in vectors.items() if i != query]
    return sorted(rows)[:k]


def test_recall_on_the_given_vectors(spark):
    for sf in ("sf0.01", "sf0.1"):
        table_ = pd.read_parquet(f"/root/testdata/{sf}/embeddings.parquet")
        vectors = dict(zip(table_.vec_id, table_.embedding))
        got = queries.op4_nearest(spark, f"/root/testdata/{sf}").toPandas()
        hits = total = 0
        for query, rows in got.groupby("query_id"):
            true = exact(vectors, query)
            assert rows["rank"].tolist() == list(range(1, 11))
            hits += len({i for _, i in true} & set(rows.vec_id))
            total += 10
            for vec, score in zip(rows.vec_id, rows.score):
                assert score == pytest.approx(np.sqrt(((np.array(vectors[vec], float) - np.array(vectors[query], float)) ** 2).sum()), abs=1e-12)
        assert total == 10 * sum(i % 100 == 0 for i in vectors) and hits / total >= 0.9


def test_transform_keeps_lengths():
    rows = np.random.default_rng(1).normal(size=(5, 8))
    assert np.allclose(np.linalg.norm(hadamard(rows), axis=1), np.linalg.norm(rows, axis=1) * 8**0.5)
    assert rotated(rows[:, :6], 0).shape == (5, 8)


def test_neighbours_of_awkward_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [float("inf"), 1.0]),
            (None, [1.0, 0.1]), (8, [-3.0, 0.5]), (100, [0.0, 2.0]), (9, [1.0, 2.0, 3.0]), (200, [7.0]), (10, []), (2, [0.9, 0.1])]
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    vectors = {i: v for i, v in rows if i in (0, 1, 2, 8, 100)}
    assert set(got) == {0, 100}
    for query, found in got.items():
        assert [(score, i) for _, score, i in sorted(found)] == exact(vectors, query)
    assert nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0


def test_ties_in_a_large_group_of_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(1, 400)] + [(1000 + i, [float(i), 1.0, 0.0, -1.0]) for i in range(50)]
    got = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).toPandas()
    for query in (100, 200, 300):
        assert got[got.query_id == query].sort_values("rank").vec_id.tolist() == [i for i in range(1, 12) if i != query][:10]


def test_distances_that_overflow_in_squares(spark):
    rows = [(0, [1e200, 0.0]), (1, [-1e200, 0.0]), (2, [1e200, 1e190]), (3, [1.7e308, 0.0]), (4, [-1.7e308, 0.0]), (100, [1e-200, 0.0]), (101, [3e-200, 0.0])]
    got = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    found = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 100)}
    assert [v for v, _ in found[0]] == [2, 100, 101, 1, 3, 4] and found[0][0][1] == pytest.approx(1e190) and found[0][3][1] == pytest.approx(2e200)
    assert found[100][0] == (101, pytest.approx(2e-200)) and len(found[100]) == 6
    far = nearest_neighbours(spark.createDataFrame([(0, [1.7e308]), (1, [-1.7e308])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r.score) for r in far] == [(1, float("inf"))]
