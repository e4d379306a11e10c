import io
import os
import random
import sys
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

sys.path.insert(0, os.path.dirname(__file__))

from helpers import AWKWARD, LONG, awkward, empty, table  # noqa: E402

from lakeprofile.llm import pieces, token_files  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PIECES)


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PIECES)


TEXTS = st.text(max_size=60) | st.lists(st.sampled_from(["the", "ing", " ", "  ", "▁", "é", "你好", "\n", "00", ".", "a", "́", "<s>"]), max_size=30).map("".join)


@given(TEXTS)
@settings(max_examples=400, deadline=None, suppress_health_check=[])
def test_pieces_are_the_librarys_and_come_back(model, library, text):
    ids = model.encode(text).tolist()
    assert ids == library.encode(text)
    assert model.decode(ids) == text.replace("▁", " ")


def test_long_runs_without_a_certain_boundary_are_committed_in_a_window(model, library):
    source = random.Random(1)
    for text in ("a" * 5000, "".join(source.choices("thequickbrownfox", k=5000)), " " * 5000, "ab" * 3000):
        assert model.encode(text).tolist() == library.encode(text)
        back = [0]
    for end in range(1, 10):
        back.append(min(end, 3) if end % 3 == 0 else 1 + (end - 1) % 3)
    assert model._committed(back, 9) == 0 or back


def test_piece_round_trip_of_awkward_rows(spark):
    got = {r.doc_id: r for r in pieces.round_trip(awkward(spark), PIECES).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[1].same and got[7].same and got[10].same and not got[11].same
    assert got[7].ids_crc32 == zlib.crc32(np.array(got[7].ids, "<u4").tobytes())
    assert pieces.round_trip(awkward(spark), PIECES).count() == len(AWKWARD)
    assert pieces.round_trip(empty(spark), PIECES).count() == 0


@given(st.integers(1, 32), st.data())
@settings(max_examples=120, deadline=None)
def test_packing(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=70)), np.uint32)
    packed = token_files.pack(ids, bits)
    assert len(packed) == (len(ids) * bits + 7) // 8
    assert token_files.unpack(packed, bits, len(ids)).tolist() == ids.tolist()


class Memory(io.BytesIO):
    def read_at(self, size, at):
        self.seek(at)
        return self.read(size)

    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("bits", [13, 16])
def test_file_layout_and_random_access(bits, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 64)
    source = np.random.default_rng(2)
    documents = [source.integers(0, 1 << bits, n, np.uint32) for n in (0, 3, 64, 200, 1, 0, 77)]
    sink = Memory()
    writer = token_files.FileWriter(sink, bits)
    for doc, ids in enumerate(documents):
        writer.add(doc * 10, ids)
    assert writer.close() == sum(map(len, documents))
    reader = token_files.FileReader(sink)
    assert reader.docs.tolist() == [doc * 10 for doc in range(len(documents))]
    for nth in (4, 0, 3, 6, 2, 5, 1):
        assert reader.document(nth).tolist() == documents[nth].tolist()
    assert reader.ids(60, 130).tolist() == np.concatenate(documents)[60:130].tolist()


def test_bits():
    assert [token_files.bits_needed(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


@given(st.lists(st.text(max_size=40) | st.sampled_from(["<|endoftext|> a", "it's 10% ΑΣ", "a<|startoftext|>b", "\x1c x\x85y", " ́e", "The END, of... it's, 'é'. x²! İI Σ. a<|endoftext|>, e\u0301, \u00ad."]), max_size=5))
@settings(max_examples=400, deadline=None)
def test_chunks_give_the_ids_of_whole_texts(texts):
    encoder = token_files.ChunkEncoder(WORDS)
    whole = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [encoder.encode(text).tolist() for text in texts] == whole


def test_letters_that_become_a_letter_and_a_mark_and_added_tokens_in_capitals():
    encoder = token_files.ChunkEncoder(WORDS)
    last = ["\u09b9\u09df", "\u0995\u09dc", "\u092a\u095c", "\u0130", "KAPI\u0130", "\ufb2a", "e\u0301", "\u00e9", "f\u00fcr", "\u4f60a", "end", "END1", "\u00b2"]
    texts = [f"{word}{signs} {word}{signs}{word}" for word in last for signs in (",", ".", "!?", ")", "...", '",', "'s,", "'")]
    texts += ["<|ENDOFTEXT|>", "a <|ENDOFTEXT|> b", "É<|EndOfText|>, The <|endoftext|>.", "<|STARTOFTEXT|>,", "A<| B|>", "\u09df<|ENDOFTEXT|>,"]
    for text in texts:
        assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_token_files_against_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(i * 3 % 101, f"text {i} it's <|endoftext|> É" * (i % 4)) for i in range(101)] + [(200, None), (201, LONG), (202, "")]
    files = token_files.write_token_files(table(spark, rows), WORDS, str(tmp_path / "ids"))
    got = {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(files).collect()}
    tokenizer, start = Tokenizer.from_file(WORDS), 0
    for doc, text in sorted(rows):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert got[doc] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not [name for name in os.listdir(tmp_path / "ids") if name.startswith("_writing")]


def test_token_files_of_awkward_rows(spark, tmp_path):
    got = token_files.read_token_files(token_files.write_token_files(awkward(spark), WORDS, str(tmp_path / "a"))).collect()
    assert sorted(str(r.id) for r in got) == sorted(str(row[0]) for row in AWKWARD)
    # Rows without an id come first, ordered by text.
    first = sorted(got, key=lambda r: r.start)[:2]
    assert [(r.id, r.start, r.n_tokens) for r in first] == [(None, 0, 1), (None, 1, 4)]
    assert token_files.read_token_files(token_files.write_token_files(empty(spark), WORDS, str(tmp_path / "b"))).count() == 0


def test_new_words_together_equal_the_library_and_the_stream():
    import random

    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    from lakeprofile.llm.pieces import BLANK, PieceModel

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, library = PieceModel(path), SentencePieceProcessor(model_file=path)
    draw = random.Random(7)
    letters = "aehilnorstuäéßçñ漢字Жя\U0001f600  \n\t.,'-_()0123ABZ"
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 90))) for _ in range(3000)] + ["x" * 500, "\n", " ", "a\n\nb", "word.\nWord", BLANK, "\x00a"]
    got = model.encode_all(texts)
    assert [ids.tolist() for ids in got] == [library.encode(text) for text in texts]
    for text in texts[:300]:
        stream = model._ids(model.cut(BLANK + text.replace(" ", BLANK))) if text else b""
        assert stream == got[texts.index(text)].tobytes()


def test_spans_that_are_no_piece_are_told_by_leading_bits():
    model = pieces.PieceModel(PIECES)
    assert model.leading[model.hashes >> np.uint64(64 - pieces._LEADING)].all() and model.leading.mean() < 0.01
    source = random.Random(4)
    texts = ["".join(source.choices("abcdefgh ▁\né0.", k=source.randrange(1, 90))) for _ in range(300)]
    texts += ["x" * 65 + " " + "y" * 200 + " and so on", "", " "]
    alone = [b"".join(model._unit(unit) for unit in model.unit.findall(pieces.BLANK + text.replace(" ", pieces.BLANK))) if text else b"" for text in texts]
    model.units.clear()
    assert [ids.tobytes() for ids in model.encode_all(texts)] == alone
