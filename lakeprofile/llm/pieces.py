"""Encodes texts with the pieces of a SentencePiece model, and decodes them.

The encoder reads a text from left to right. For each position it looks at the pieces that end there and keeps the one way in
which the text so far can end: a piece survives if the model's merges, applied to the piece before and to it, leave exactly
these two. Each position thus has one backpointer, none longer than the longest piece. As soon as the paths from all positions
that a later piece could still start from meet in one boundary, the ids before it are committed and forgotten; the window stays
a few pieces long however long the text is. Between two characters that stand side by side in no piece all paths meet in any
case (before a blank that follows a letter, say, or before most commas), and the ids of what lies between are remembered.

New words of many texts take these steps together: one array holds the backpointers of them all, and each step looks at the
pieces that end at one position of every word, told by hashes of their characters. A word's pieces are compared with it as
text at the end, so a hash that two texts share costs time and no correctness.

The ids are those that the library itself gives.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from lakeprofile.llm.common import per_process

BLANK = "▁"
_MEMO = 220_000
_REMEMBERED = 64  # characters
_CHECK = 8  # longest pieces between two looks for a common boundary
_CHARACTERS = 1 << 20  # of texts whose new words are encoded together, one text at least
_ROWS = 512  # handed back at once
_WORDS = 8192  # in one array
_PAIRS = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
# Codes of pieces in arrays: 0 at the start of a word, then ids from 1, then characters that are no piece.
_CHARACTER = 1 << 21
_CODE_BITS = 22
_LEADING = 22


class _Pairs(dict):
    """Whether a piece may follow another, by both codes, worked out when first asked for."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, key: int) -> bool:
        if len(self) > _PAIRS:
            self.clear()
        self[key] = stands = self.model._stands(*map(self.model.text_of, (key >> _CODE_BITS, key & ((1 << _CODE_BITS) - 1))))
        return stands


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        plain = [i for i in range(size) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))]
        self.pieces = [library.id_to_piece(i) for i in range(size)]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: library.get_score(i) for i in plain}
        self.bytes = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes) if library.is_byte(i)}
        self.unknown = library.unk_id()
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else piece.encode() if piece in self.ids else b""
                    for i, piece in enumerate(self.pieces)]
        self.longest = max(map(len, self.ids))
        # Characters that stand side by side in a piece, and the lengths of the pieces by their last character, longest first.
        self.inner = {piece[i: i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        by_end: dict[str, set[int]] = {}
        for piece in self.ids:
            by_end.setdefault(piece[-1], {1}).add(len(piece))
        self.lengths = {end: sorted(lengths, reverse=True) for end, lengths in by_end.items()}
        self.stands = lru_cache(1 << 17)(self._stands)
        self.units: dict[str, bytes] = {}
        self.pairs = _Pairs(self)
        self.powers = np.full(max(_REMEMBERED, self.longest) + 1, _BASE, np.uint64)
        self.powers[0] = 1
        self.powers = np.multiply.accumulate(self.powers)
        hashes = np.array([int(self._hashes(piece)[-1]) for piece in self.ids], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.hash_codes = hashes[order], np.array(list(self.ids.values()), np.int64)[order] + 1
        # Which leading bits of a hash any piece has: most spans that are no piece are told by them.
        self.leading = np.zeros(1 << _LEADING, bool)
        self.leading[self.hashes >> np.uint64(64 - _LEADING)] = True
        self.unit = self._unit_pattern()
        # Per pair of characters, the lengths from 2 of the pieces that it ends, as bits. Pairs share entries by chance.
        self.ending = np.zeros(1 << 20, np.uint64)
        for piece in self.ids:
            if len(piece) > 1:
                self.ending[self._pair_place(ord(piece[-2]), ord(piece[-1]))] |= np.uint64(1 << min(len(piece), 63))
        self.single = np.arange(_CHARACTER, _CHARACTER + 0x110000, dtype=np.int32)
        for piece, code in self.ids.items():
            if len(piece) == 1:
                self.single[ord(piece)] = code + 1
        self.sizes = np.array([0, *map(len, self.pieces)])

    def _unit_pattern(self) -> re.Pattern:
        """Cuts a text where no piece reaches across: before blanks, around line breaks, and behind words, as far as this model allows."""
        breaks = "".join(c for c in "\n\r\t" if not any(c in pair for pair in self.inner))
        joined = "".join(sorted({pair[1] for pair in self.inner if pair[0].isalpha() and not pair[1].isalpha()}))
        behind = f"(?![{re.escape(joined)}])" if joined else ""
        start, own = (f"(?:{BLANK}+|(?<=[{breaks}]))", f"[{breaks}]+|") if breaks else (f"{BLANK}+", "")
        return re.compile(f"{start}[^\\W\\d_]++{behind}|{own}{BLANK}+[^{BLANK}{breaks}]*|[^{BLANK}{breaks}]+")

    @staticmethod
    def _hashes(text: str) -> np.ndarray:
        found = np.zeros((1, len(text) + 1), np.uint64)
        for i, character in enumerate(text):
            found[:, i + 1] = found[:, i] * _BASE + np.uint64(ord(character) + 1)
        return found[0]

    @staticmethod
    def _pair_place(first, second):
        return (first * 8191 + second) & ((1 << 20) - 1)

    def text_of(self, code: int) -> str:
        return "" if code == 0 else chr(code - _CHARACTER) if code >= _CHARACTER else self.pieces[code - 1]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text after all merges: best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at: at + 2] = [parts[at] + parts[at + 1]]

    def _stands(self, before: str, piece: str) -> bool:
        """Whether ``piece`` may follow ``before`` (empty at the start)."""
        return self.merged(before + piece) == ([before, piece] if before else [piece])

    def _committed(self, back: list[int], end: int) -> int:
        """The last boundary that the paths from all positions a later piece may start from share."""
        ends = set(range(max(0, end - self.longest + 1), end + 1))
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(last - back[last])
        return ends.pop()

    def cut(self, text: str) -> Iterator[str]:
        """The pieces of ``text``, each as soon as it is certain."""
        # back[i]: length of the piece that ends at position base + i; the window starts at a certain boundary.
        base, back, last = 0, [0], [""]
        look = _CHECK * self.longest

        def path(end: int) -> list[str]:
            found = []
            while end > 0:
                found.append(last[end])
                end -= back[end]
            return found[::-1]

        scores, stands, lengths, alone = self.scores, self.stands, self.lengths, (1,)
        for end in range(1, len(text) + 1):
            here = end - base
            for length in lengths.get(text[end - 1], alone):
                if length <= here:
                    piece = text[end - length: end]
                    if (piece in scores or length == 1) and stands(last[here - length], piece):
                        break
            back.append(length)
            last.append(piece)
            if here >= look:
                boundary = self._committed(back, here)
                if boundary > 0:
                    yield from path(boundary)
                    base += boundary
                    back, last = back[boundary:], last[boundary:]
                    back[0] = 0
        yield from path(len(text) - base)

    def _ids(self, pieces: Iterator[str]) -> bytes:
        ids: list[int] = []
        for piece in pieces:
            if piece in self.ids:
                ids.append(self.ids[piece])
            elif self.byte_of:
                ids += [self.bytes[b] for b in piece.encode()]
            else:
                ids.append(self.unknown)
        return struct.pack(f"<{len(ids)}i", *ids)

    def _unit(self, unit: str) -> bytes:
        """The ids of a unit, from those of its parts between which no piece reaches."""
        inner, memo, parts, start = self.inner, self.units, [], 0
        for end in range(1, len(unit) + 1):
            if end == len(unit) or unit[end - 1: end + 1] not in inner:
                part = unit[start:end]
                known = memo.get(part)
                if known is None:
                    known = self._ids(self.cut(part))
                    if len(part) <= _REMEMBERED:
                        memo[part] = known
                parts.append(known)
                start = end
        return b"".join(parts)

    def _words(self, words: list[str]) -> None:
        """Remembers the ids of many short words, found together."""
        words.sort(key=len)
        sizes = np.array(list(map(len, words)))
        widest, rows = int(sizes[-1]), np.arange(len(words))
        characters = np.zeros((len(words), widest), np.int64)
        characters[np.arange(widest) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        sums = np.zeros((len(words), widest + 1), np.uint64)
        for at in range(widest):
            sums[:, at + 1] = sums[:, at] * _BASE + (characters[:, at] + 1).astype(np.uint64)
        # A single character stands wherever no longer piece does.
        last, back = np.zeros((len(words), widest + 1), np.int64), np.ones((len(words), widest + 1), np.int8)
        last[:, 1:] = self.single[characters]
        for end in range(2, widest + 1):
            waiting = rows[np.searchsorted(sizes, end):]
            lengths = self.ending[self._pair_place(characters[waiting, end - 2], characters[waiting, end - 1])]
            some = lengths != 0
            waiting, lengths = waiting[some], lengths[some]
            for length in range(min(end, self.longest), 1, -1):
                some = np.flatnonzero(lengths & np.uint64(1 << min(length, 63)))
                if not len(some):
                    continue
                at = waiting[some]
                wanted = sums[at, end] - sums[at, end - length] * self.powers[length]
                likely = np.flatnonzero(self.leading[wanted >> np.uint64(64 - _LEADING)])
                if not len(likely):
                    continue
                some, at, wanted = some[likely], at[likely], wanted[likely]
                place = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
                known = self.hashes[place] == wanted
                some, at, codes = some[known], at[known], self.hash_codes[place[known]]
                keys = (last[at, end - length] << _CODE_BITS) | codes
                stands = np.fromiter(map(self.pairs.__getitem__, keys.tolist()), bool, len(keys))
                last[at[stands], end], back[at[stands], end] = codes[stands], length
                lengths[some[stands]] = 0
        # All paths back at once, the last piece of each first.
        ends, going, codes, lengths = sizes.copy(), rows, np.zeros((len(words), widest), np.int64), np.zeros((len(words), widest), np.int8)
        place = np.full(len(words), widest)
        while len(going):
            place[going] -= 1
            end = ends[going]
            codes[going, place[going]], lengths[going, place[going]] = last[going, end], back[going, end]
            ends[going] = end - back[going, end]
            going = going[ends[going] > 0]
        odd = codes.max(axis=1) >= _CHARACTER
        for row in np.flatnonzero(odd).tolist():
            pieces = [self.text_of(code) for code in codes[row, place[row]:].tolist()]
            self.units[words[row]] = self._ids(pieces) if "".join(pieces) == words[row] else self._unit(words[row])
        used = (np.arange(widest) >= place[:, None]) & ~odd[:, None]
        found = codes[used]
        plain = [words[row] for row in np.flatnonzero(~odd).tolist()]
        if (self.sizes[found] == lengths[used]).all() and "".join(map(self.pieces.__getitem__, (found - 1).tolist())) == "".join(plain):
            packed, edges = (found - 1).astype("<i4").tobytes(), [0, *(4 * np.cumsum(used[~odd].sum(axis=1))).tolist()]
            self.units.update(zip(plain, map(packed.__getitem__, map(slice, edges, edges[1:]))))
        else:
            self.units.update((word, self._unit(word)) for word in plain)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, of which a blank is put in front; none for an empty text."""
        found, start = [], 0
        while start < len(texts):
            end, characters = start + 1, len(texts[start])
            while end < len(texts) and characters + len(texts[end]) <= _CHARACTERS:
                characters += len(texts[end])
                end += 1
            units = [self.unit.findall(BLANK + text.replace(" ", BLANK)) if text else [] for text in texts[start:end]]
            start = end
            wanted = set().union(*units)
            if len(self.units) + len(wanted) > _MEMO:
                self.units.clear()
            new = [unit for unit in wanted.difference(self.units) if len(unit) <= _REMEMBERED]
            for at in range(0, len(new), _WORDS):
                self._words(new[at: at + _WORDS])
            del wanted, new
            for nth in range(len(units)):
                try:
                    ids = b"".join(map(self.units.__getitem__, units[nth]))
                except KeyError:  # some of them aren't remembered
                    ids = b"".join([self.units.get(unit) or self._unit(unit) for unit in units[nth]])
                units[nth] = None
                found.append(np.frombuffer(ids, "<i4"))
        return found

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The text of ids: byte pieces become their bytes, and the blank in front goes. Unknown and control ids have no text."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text[:1] == " " else text


def encode(text: Column, model_path: str) -> Column:
    """A struct of ``ids`` and ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers). Null texts count as empty."""
    @F.pandas_udf("ids array<int>, ids_crc32 long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = per_process(f"pieces {model_path}", lambda: PieceModel(model_path))
        for batch in batches:
            ids = model.encode_all([text or "" for text in batch])
            yield pd.DataFrame({"ids": ids, "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids]})

    return run(text)


def decode(ids: Column, model_path: str) -> Column:
    """The texts of arrays of ids; null for null."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = per_process(f"pieces {model_path}", lambda: PieceModel(model_path))
        for batch in batches:
            yield pd.Series([None if x is None else model.decode(x.tolist()) for x in batch], dtype=object)

    return run(ids)


def round_trip(docs, model_path: str, id_col: str = "doc_id", text_col: str = "text"):
    """Per row: its id, ``n_tokens``, ``ids_crc32``, ``ids`` and ``same``, whether decoding gives the text back.

    A null text counts as empty. Texts that hold the blank's own sign (U+2581) come back with blanks there, as the model has
    one sign for both, and aren't the same.
    """
    @F.pandas_udf("n_tokens long, ids_crc32 long, ids array<int>, same boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = per_process(f"pieces {model_path}", lambda: PieceModel(model_path))
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                texts = [text or "" for text in batch.iloc[at: at + _ROWS]]
                rows = [(len(ids), zlib.crc32(ids.tobytes()), ids, model.decode(ids.tolist()) == text) for text, ids in zip(texts, model.encode_all(texts))]
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_crc32", "ids", "same"])

    return docs.select(F.col(f"`{id_col}`"), run(F.col(f"`{text_col}`")).alias("__got")).select(F.col(f"`{id_col}`"), "__got.*")
