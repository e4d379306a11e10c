"""Whole-file counts over byte ranges, so one huge file is many tasks.

A file is cut into chunks of equal size, whatever their content. Each task reads its chunk alone and reports what it
would do from every state the previous chunk may have ended in; joining these outcomes in order gives the true path.
Counts are exact for any line length and any number of quoted line breaks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lakeprofile.session import spread
from lakeprofile.sources.storage import Storage

CHUNK_BYTES = 32 * 1024 * 1024
CR, LF, QUOTE = 13, 10, 34


def plan_chunks(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk: all columns of ``files`` (``path``, ``size``, ...) with ``chunk`` and ``offset``.

    Chunk size is even, so two-byte characters stay whole.
    """
    step = max(chunk_bytes // 4 * 4, 4)
    last = F.greatest(F.ceil(F.col("size") / step) - 1, F.lit(0))
    chunked = files.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk"))
    return spread(chunked.withColumn("offset", F.col("chunk") * step).withColumn("length", F.lit(step)),
                  "path", "chunk")


def read_range(storage: Storage, path: str, offset: int, length: int) -> tuple[bytes, bytes]:
    """(up to four bytes before the range, the range itself)."""
    with storage.open(path) as handle:
        lead = min(offset, 4)
        handle.seek(offset - lead)
        data = handle.read(lead + length)
    return data[:lead], data[lead:]


def byte_order(encoding: str | None, storage: Storage, path: str) -> tuple[str | None, int]:
    """(Python codec for wide encodings or None, size of the byte-order mark)."""
    if not encoding or not encoding.startswith(("utf-16", "utf-32", "utf-8-sig")):
        return None, 0
    head = storage.read_head(path, 4)
    if encoding == "utf-8-sig":
        return None, 3 if head.startswith(b"\xef\xbb\xbf") else 0
    if encoding.startswith("utf-32"):
        return ("utf-32-be" if head == b"\x00\x00\xfe\xff" else "utf-32-le"), 4
    marked = head[:2] in (b"\xff\xfe", b"\xfe\xff")
    big = head[:2] == b"\xfe\xff" or (encoding == "utf-16-be" and not marked)
    return ("utf-16-be" if big else "utf-16-le"), 2 if marked else 0


def narrow(lead: bytes, data: bytes, offset: int, codec: str | None, mark: int) -> tuple[bytes, bytes]:
    """The range with its byte-order mark removed and wide characters turned into UTF-8."""
    if offset == 0 and mark:
        data = data[mark:]
    if codec:
        return lead.decode(codec, "replace").encode(), data.decode(codec, "replace").encode()
    return lead, data


def line_ends(lead: bytes, data: bytes) -> np.ndarray:
    """Positions of line terminators: LF, CR, or the CR of a CR LF pair."""
    view = np.frombuffer(data, dtype=np.uint8)
    breaks = np.flatnonzero((view == LF) | (view == CR))
    if len(breaks) == 0:
        return breaks
    before = np.where(breaks > 0, view[breaks - 1], lead[-1] if lead else 0)
    return breaks[~((view[breaks] == LF) & (before == CR))]


# ---------------------------------------------------------------------------------------------------------------------
# Lines
# ---------------------------------------------------------------------------------------------------------------------


def _count_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    storage = Storage()
    for batch in batches:
        rows = []
        for path, encoding, chunk, offset, length in batch[
            ["path", "encoding", "chunk", "offset", "length"]
        ].itertuples(index=False):
            try:
                codec, mark = byte_order(encoding, storage, path)
                lead, data = narrow(*read_range(storage, path, offset, length), offset, codec, mark)
                open_end = data[-1] not in (CR, LF) if data else None
                rows.append((path, chunk, len(line_ends(lead, data)), open_end, None))
            except Exception as problem:
                rows.append((path, chunk, None, None, str(problem)))
        yield pd.DataFrame(rows, columns=["path", "chunk", "lines", "open_end", "error"]).astype({"lines": "Int64"})


def line_counts(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Lines per file (``path``, ``row_count``, ``error``); files come with ``path``, ``size``, ``encoding``."""
    counted = plan_chunks(files.select("path", "size", "encoding"), chunk_bytes).mapInPandas(
        _count_lines, "path string, chunk bigint, lines bigint, open_end boolean, error string"
    )
    unfinished = F.max_by("open_end", F.when(F.col("open_end").isNotNull(), F.col("chunk")))
    return (
        counted.groupBy("path")
        .agg(F.sum("lines").alias("lines"), unfinished.alias("open_end"), F.max("error").alias("error"))
        .select(
            "path",
            F.when(F.col("error").isNull(),
                   F.coalesce(F.col("lines"), F.lit(0)) + F.when(F.col("open_end"), 1).otherwise(0)).alias("row_count"),
            "error",
        )
    )


# ---------------------------------------------------------------------------------------------------------------------
# Delimited records
# ---------------------------------------------------------------------------------------------------------------------

# States between two bytes of a delimited file. A quote opens a field only at its start; inside, a doubled quote
# is one character and a single one closes.
RECORD_START, FIELD_START, PLAIN, QUOTED, QUOTE_SEEN = range(5)


def walk(state: int, text: bytes, delimiter: bytes) -> int:
    """State after a piece of a line (no terminator in it)."""
    position, size = 0, len(text)
    while position < size:
        if state == PLAIN:
            position = text.find(delimiter, position) + 1
            if position == 0:
                return PLAIN
            state = FIELD_START
        elif state == QUOTED:
            position = text.find(b'"', position) + 1
            if position == 0:
                return QUOTED
            state = QUOTE_SEEN
        else:
            here = text[position:position + 1]
            if here == b'"':
                state = QUOTED
            elif here == delimiter:
                state = FIELD_START
            else:
                state = PLAIN
            position += 1
    return state


def end_line(state: int) -> tuple[int, int]:
    """(state after a terminator, records it ends)."""
    return (QUOTED, 0) if state == QUOTED else (RECORD_START, 1)


def chunk_outcomes(lead: bytes, data: bytes, delimiter: bytes) -> list[tuple[int, int]]:
    """For each state the chunk may start in: (state it ends in, records it completes)."""
    ends = line_ends(lead, data)
    view = np.frombuffer(data, dtype=np.uint8)
    # A line starts after its predecessor's terminator; the LF of a pair belongs to the terminator.
    starts = ends + 1
    paired = np.zeros(len(ends), dtype=bool)
    inside = starts < len(view)
    paired[inside] = (view[ends[inside]] == CR) & (view[starts[inside]] == LF)
    starts = starts + paired
    if len(ends) == 0:
        skip = 1 if data[:1] == b"\n" and lead[-1:] == b"\r" else 0
        # A lone LF after a CR is content only inside quotes, where it changes nothing.
        return [(walk(state, data[skip:], delimiter), 0) for state in range(5)]

    # Between the first and the last terminator only lines with quotes can change the state.
    quotes = np.flatnonzero(view == QUOTE)
    quotes = quotes[(quotes >= starts[0]) & (quotes < ends[-1])]
    quoted_lines = np.unique(np.searchsorted(starts, quotes, side="right")) if len(quotes) else []
    inner = {RECORD_START: [RECORD_START, 0], QUOTED: [QUOTED, 0]}
    done = 1
    for line in quoted_lines:
        gap = int(line) - done
        text = data[starts[line - 1]:ends[line]]
        steps = {state: end_line(walk(state, text, delimiter)) for state in (RECORD_START, QUOTED)}
        for path in inner.values():
            if path[0] == RECORD_START:
                path[1] += gap
            state, ended = steps[path[0]]
            path[0] = state
            path[1] += ended
        done = int(line) + 1
    for path in inner.values():
        if path[0] == RECORD_START:
            path[1] += len(ends) - done
    skip = 1 if data[:1] == b"\n" and lead[-1:] == b"\r" else 0
    tail = data[starts[-1]:]
    outcomes = []
    for state in range(5):
        middle, first_ended = end_line(walk(state, data[skip:ends[0]], delimiter))
        final, ended = inner[middle]
        outcomes.append((walk(final, tail, delimiter), first_ended + ended))
    return outcomes


def _count_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    storage = Storage()
    for batch in batches:
        rows = []
        for path, encoding, delimiter, chunk, offset, length in batch[
            ["path", "encoding", "delimiter", "chunk", "offset", "length"]
        ].itertuples(index=False):
            try:
                codec, mark = byte_order(encoding, storage, path)
                lead, data = narrow(*read_range(storage, path, offset, length), offset, codec, mark)
                outcomes = chunk_outcomes(lead, data, (delimiter or ",").encode())
                rows.append((path, chunk, len(line_ends(lead, data)), [state for state, _ in outcomes],
                             [count for _, count in outcomes], None))
            except Exception as problem:
                rows.append((path, chunk, None, None, None, str(problem)))
        frame = pd.DataFrame(rows, columns=["path", "chunk", "lines", "states", "counts", "error"])
        yield frame.astype({"lines": "Int64"})


# Chunks whose outcomes are joined into one before the file as a whole is followed: no group grows beyond this, and
# a file of 30 TB comes down to a thousand rows.
CHUNKS_PER_BLOCK = 1024


def _joined(steps: Column) -> Column:
    """Outcomes of consecutive pieces as the outcome of one: for each start state, where it ends and what it completes."""
    nothing = F.struct(
        F.array(*[F.lit(state) for state in range(5)]).alias("states"),
        F.array(*[F.lit(0).cast("bigint")] * 5).alias("counts"),
    )
    return F.aggregate(
        F.sort_array(steps), nothing,
        lambda reached, step: F.struct(
            F.transform(reached["states"], lambda state: F.get(step["states"], state)).alias("states"),
            F.zip_with(reached["counts"], reached["states"],
                       lambda count, state: count + F.get(step["counts"], state)).alias("counts"),
        ),
    )


def record_counts(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Records per delimited file, header and blank lines included (``path, records, quoted_breaks, error``).

    ``quoted_breaks`` tells whether a line break stands inside a field, so that a reader needs ``multiLine``. Files come
    with ``path``, ``size``, ``encoding``, ``delimiter``.     """
    counted = plan_chunks(files.select("path", "size", "encoding", "delimiter"), chunk_bytes).mapInPandas(
        _count_records,
        "path string, chunk bigint, lines bigint, states array<int>, counts array<bigint>, error string",
    )
    block = F.floor(F.col("chunk") / CHUNKS_PER_BLOCK).alias("block")
    blocks = counted.groupBy("path", block).agg(
        _joined(F.collect_list(F.struct("chunk", "states", "counts"))).alias("joined"),
        F.sum("lines").alias("lines"), F.max("error").alias("error"),
    )
    followed = blocks.groupBy("path").agg(
        _joined(F.collect_list(F.struct("block", "joined.states", "joined.counts"))).alias("joined"),
        F.sum("lines").alias("lines"), F.max("error").alias("error"),
    ).select(
        "path", "lines", "error",
        F.struct(F.get("joined.states", F.lit(RECORD_START)).alias("state"),
                 F.get("joined.counts", F.lit(RECORD_START)).alias("records")).alias("end"),
    )
    unfinished = F.when(F.col("end.state") == RECORD_START, 0).otherwise(1)
    sound = F.col("error").isNull()
    return followed.select(
        "path", F.when(sound, F.col("end.records") + unfinished).alias("records"),
        F.when(sound, F.col("lines") > F.col("end.records")).alias("quoted_breaks"), "error",
    )


# ---------------------------------------------------------------------------------------------------------------------
# Whole lines, for line-delimited documents
# ---------------------------------------------------------------------------------------------------------------------


def lines_of_range(storage: Storage, path: str, encoding: str | None, offset: int, length: int,
                   max_chars: int | None = None) -> Iterator[str | None]:
    """Lines that start in the range, whatever their length.

    With ``max_chars`` a longer line gives ``None``; far longer, it ends the range.
    """
    codec, mark = byte_order(encoding, storage, path)
    unit = 1 if codec is None else (2 if codec.startswith("utf-16") else 4)
    text_codec = codec or ("utf-8" if encoding in (None, "utf-8-sig") else encoding)
    newline = "\n".encode(codec) if codec else b"\n"
    carriage = "\r".encode(codec) if codec else b"\r"

    def ends_line(piece: bytes, position: int) -> bool:
        return piece[position:position + unit] in (newline, carriage)

    with storage.open(path) as handle:
        size = handle.size()
        position = offset if offset else mark
        if offset:
            # The line that began before the range belongs to the range it began in.
            handle.seek(offset - unit)
            if not ends_line(handle.read(unit), 0):
                position = _next_line_start(handle, offset, size, unit, newline, carriage)
            else:
                handle.seek(offset - unit)
                pair = handle.read(2 * unit)
                if pair == carriage + newline:
                    position = offset + unit
        limit = offset + length
        handle.seek(position)
        pending = b""
        while position < limit and position < size:
            piece = handle.read(1 << 20)
            if not piece:
                break
            pending += piece
            at_end = handle.tell() >= size
            start = 0
            while True:
                found = _find_end(pending, start, unit, newline, carriage)
                # A CR at the very end of the buffer may be half of a pair.
                if found < 0 or (found + 2 * unit > len(pending) and not at_end):
                    break
                stop = found + unit
                if pending[found:stop] == carriage and pending[stop:stop + unit] == newline:
                    stop += unit
                yield _line(pending[start:found], text_codec, max_chars)
                position += stop - start
                start = stop
                if position >= limit:
                    return
            pending = pending[start:]
            if max_chars is not None and len(pending) > 4 * max_chars + 8:
                yield None
                return
        if pending and position < limit:
            yield _line(pending, text_codec, max_chars)


def _line(raw: bytes, codec: str, max_chars: int | None) -> str | None:
    text = raw.decode(codec, "replace")
    return None if max_chars is not None and len(text) > max_chars else text


def _find_end(data: bytes, start: int, unit: int, newline: bytes, carriage: bytes) -> int:
    """Position of the next terminator on a character boundary, or -1."""
    best = -1
    for mark in (newline, carriage):
        at = data.find(mark, start)
        while at >= 0 and (at - start) % unit:
            at = data.find(mark, at + 1)
        if at >= 0 and (best < 0 or at < best):
            best = at
    return best


def _next_line_start(handle, offset: int, size: int, unit: int, newline: bytes, carriage: bytes) -> int:
    position = offset
    handle.seek(position)
    while position < size:
        piece = handle.read(1 << 20)
        if not piece:
            break
        found = _find_end(piece, 0, unit, newline, carriage)
        if found >= 0:
            stop = position + found + unit
            if piece[found:found + unit] == carriage:
                handle.seek(stop)
                if handle.read(unit) == newline:
                    stop += unit
            return stop
        position += len(piece)
    return size


def _read_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    storage = Storage()
    for batch in batches:
        for path, encoding, chunk, offset, length in batch[
            ["path", "encoding", "chunk", "offset", "length"]
        ].itertuples(index=False):
            names = ["path", "chunk", "number", "line", "error"]
            lines = []
            number = 0
            try:
                for number, line in enumerate(lines_of_range(storage, path, encoding, offset, length)):
                    lines.append((path, chunk, number, line, None))
                    if len(lines) == 10_000:
                        yield pd.DataFrame(lines, columns=names)
                        lines = []
            except Exception as problem:
                lines.append((path, chunk, number + 1, None, str(problem)))
            if lines:
                yield pd.DataFrame(lines, columns=names)


def read_lines(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every line of every file; ``chunk, number`` order the lines of a file.

    What can't be read gives a row with an ``error`` and no line.
    """
    return plan_chunks(files.select("path", "size", "encoding"), chunk_bytes).mapInPandas(
        _read_lines, "path string, chunk bigint, number bigint, line string, error string"
    )
