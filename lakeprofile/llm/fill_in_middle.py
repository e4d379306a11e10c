"""Fill-in-middle: documents rearranged so that a model learns to write a middle from what stands before and after it.

A document is a piece table: a list of descriptors (buffer, start, end) over two buffers that never change, the text's own
bytes and the sentinels'. Cutting splits a descriptor in two, an arrangement is a permutation of descriptors, the inverse
permutation restores, and a hash takes the descriptors' bytes one after the other. Text is copied only where an output is
written.

Each document is the work of the task that holds it: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

#: The sentinel buffer holds prefix, suffix and middle marks.
SENTINELS = b"<P><S><M>"
_MARK = re.compile(rb"<[PSM]>")
TEXT, MARKS = 0, 1
#: Shares in percent: documents that are rearranged, and of these the ones with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Bytes looked at at once when code points are counted.
_STEP = 1 << 20

Piece = tuple[int, int, int]  # buffer, first byte, byte after the last
#: Pieces of a cut document: 0 prefix, 1 middle, 2 suffix, then the marks: 3 prefix's, 4 suffix's, 5 middle's.
ORDERS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
_MARK_PIECES = [(MARKS, 0, 3), (MARKS, 3, 6), (MARKS, 6, 9)]


def cut(pieces: Sequence[Piece], at: int) -> list[Piece]:
    """The descriptors, with the one that holds the document's byte ``at`` split there; a cut at an edge leaves an empty one."""
    for nth, (buffer, start, end) in enumerate(pieces):
        if at <= end - start:
            return [*pieces[:nth], (buffer, start, start + at), (buffer, start + at, end), *pieces[nth + 1:]]
        at -= end - start
    raise ValueError("a cut beyond the end of the document")


def arranged(pieces: Sequence[Piece], order: Sequence[int]) -> list[Piece]:
    return [pieces[i] for i in order]


def inverse(order: Sequence[int]) -> list[int]:
    back = [0] * len(order)
    for place, piece in enumerate(order):
        back[piece] = place
    return back


def stream(buffers: Sequence[memoryview], pieces: Iterable[Piece]) -> Iterator[memoryview]:
    """The document's bytes, piece by piece, without copies."""
    return (buffers[buffer][start:end] for buffer, start, end in pieces)


def digest(buffers: Sequence[memoryview], pieces: Iterable[Piece]) -> str:
    hashed = hashlib.sha256()
    for part in stream(buffers, pieces):
        hashed.update(part)
    return hashed.hexdigest()


def code_points(data: np.ndarray) -> list[int]:
    """How many code points start in each step of the UTF-8 bytes."""
    return [int(np.count_nonzero((data[at: at + _STEP] & 0xC0) != 0x80)) for at in range(0, len(data), _STEP)]


def byte_offset(data: np.ndarray, counts: list[int], point: int) -> int:
    """The byte at which code point number ``point`` starts; the end for the number after the last."""
    for step, count in enumerate(counts):
        if point < count:
            block = data[step * _STEP: (step + 1) * _STEP]
            return step * _STEP + int(np.flatnonzero((block & 0xC0) != 0x80)[point])
        point -= count
    return len(data)


def rearrange(text: memoryview, draws: Sequence[int], rate: int = RATE, suffix_first: int = SUFFIX_FIRST):
    """Length in code points, form, code points of prefix and middle (None if plain), and the arranged descriptors.

    ``draws`` are four random numbers: two cuts, whether to rearrange, and which form. A text that is empty or holds a mark
    stays plain.
    """
    data = np.frombuffer(text, np.uint8)
    counts = code_points(data)
    n, whole = sum(counts), [(TEXT, 0, len(data))]
    if not n or draws[2] % 100 >= rate or _MARK.search(text):
        return n, "plain", None, None, whole
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    form = "spm" if draws[3] % 100 < suffix_first else "psm"
    start, end = byte_offset(data, counts, first), byte_offset(data, counts, second)
    parts = cut(cut(whole, end), start)
    return n, form, first, second - first, arranged([*parts, *_MARK_PIECES], ORDERS[form])


def restored(output: memoryview, form: str) -> list[Piece]:
    """Descriptors over ``output`` that give the document back. The three marks are found in it: the text itself holds none."""
    if form == "plain":
        return [(TEXT, 0, len(output))]
    edges = [mark.start() for mark in _MARK.finditer(output)] + [len(output)]
    found = [piece for at, to in zip(edges, edges[1:]) for piece in ((TEXT, at, at + 3), (TEXT, at + 3, to))]
    return arranged(found, inverse(ORDERS[form]))[:3]


def _views(column: pa.Array) -> list[memoryview]:
    """The UTF-8 bytes of each value, null as empty, without copies."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")
    valid = column.is_valid().to_pylist()
    return [data[offsets[i]: offsets[i + 1]] if valid[i] else data[:0] for i in range(len(column))]


_FIELDS = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
           ("pieces", pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))),
           ("output", pa.string()), ("output_sha256", pa.string())]
_SCHEMA = ("n long, form string, prefix_chars long, middle_chars long,"
           " pieces array<struct<buffer int, start long, end long>>, output string, output_sha256 string")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", rate: int = RATE,
                   suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n`` (code points), ``form`` (plain, psm or spm), ``prefix_chars`` and
    ``middle_chars`` (null if plain), ``pieces`` (the arranged descriptors; buffer 0 is the text, 1 the sentinels; in
    bytes), ``output`` and ``output_sha256``.

    The draws are groups of the SHA-256 of ``seed:id``, so they don't depend on order, partitions or retries: rows that repeat
    an id are cut at the same draws, and a null id counts as an empty one. A null text counts as empty and stays plain. An
    empty table gives an empty table. Further columns are left out.
    """
    @F.arrow_udf(_SCHEMA)
    def run(text: pa.Array, drawn: pa.Array) -> pa.Array:
        marks, rows = memoryview(SENTINELS), []
        for view, hexed in zip(_views(text), drawn.to_pylist()):
            n, form, prefix, middle, pieces = rearrange(view, [int(hexed[at: at + 8], 16) for at in (0, 8, 16, 24)], rate, suffix_first)
            output = b"".join(stream((view, marks), pieces)).decode()
            rows.append((n, form, prefix, middle, [dict(zip(("buffer", "start", "end"), p)) for p in pieces], output, digest((view, marks), pieces)))
        columns = zip(*rows) if rows else [[]] * len(_FIELDS)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], [name for name, _ in _FIELDS])

    draws = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    return docs.select(F.col(f"`{id_col}`").alias("id"), run(F.col(f"`{text_col}`"), draws).alias("done")).select("id", "done.*")


def _of_output(make: Callable[[tuple[memoryview], list[Piece]], str]) -> Callable[[Column, Column], Column]:
    def run(output: pa.Array, form: pa.Array) -> pa.Array:
        return pa.array([make((view,), restored(view, kind)) for view, kind in zip(_views(output), form.to_pylist())], pa.string())

    return F.arrow_udf(run, StringType())


def restored_text(output: Column, form: Column) -> Column:
    """The document that was rearranged into ``output``."""
    return _of_output(lambda buffers, pieces: b"".join(stream(buffers, pieces)).decode())(output, form)


def restored_sha256(output: Column, form: Column) -> Column:
    """The SHA-256 of ``restored_text``, streamed over its descriptors."""
    return _of_output(digest)(output, form)
