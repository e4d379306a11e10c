import os
import re
import sys

import pandas as pd
import public_tokenizers

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline  # noqa: E402
from helpers import awkward, empty  # noqa: E402
from test_decontaminate import brute as contaminated  # noqa: E402
from test_line_dedup import brute as without_lines  # noqa: E402
from test_near_duplicates import brute as groups  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    from sentencepiece import SentencePieceProcessor

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    rows = [(i, text) for i, text in zip(docs.doc_id, docs.text) if re.search(r"[^\W\d_]", text or "")]
    cut = without_lines(rows)
    rows = [(i, cut[i]) for i, text in rows if cut[i] == text or cut[i].strip(" \n\r\t")]
    component = groups(rows, 5)
    rows = [(i, text) for i, text in rows if component[i][1] == i]
    hit = contaminated(rows, list(zip(items.item_id, items.text)))
    rows = [(i, text) for i, text in rows if not hit[i][1]]
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: list(r.ids) for i, r in got.items()} == {i: library.encode(text) for i, text in rows}
    assert all(r.same for r in got.values())


def test_stages_keep_the_columns_and_stand_awkward_tables(spark):
    for source in (awkward(spark), empty(spark)):
        docs = source
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == source.columns, name
            # Columns that share a name with an operator's own come through as they are.
            assert all(r[c] == "other" for r in docs.collect() for c in docs.columns[3:]), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() <= source.count()
