"""Elements of JSON array files, found in byte ranges.

A bracket or comma counts only outside strings, and at a depth that everything before decides. Each chunk of a file is looked
at alone: for every state of a string it may start in, a task reports the state it ends in and by how much it changes the
depth. An ordered fold gives each chunk its true start; then each chunk's task yields the elements that begin in it and reads
on to the end of the last one. No task and no row holds a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lakeprofile.session import spread, write_and_read
from lakeprofile.sources.chunks import CHUNK_BYTES, CHUNKS_PER_BLOCK, plan_chunks, read_range
from lakeprofile.sources.storage import Storage

# Where a chunk may start: outside strings, inside one, inside one right after a backslash that escapes.
OUTSIDE, INSIDE, ESCAPED = range(3)
_BLANK = b" \t\r\n"
_MARK = b"\xef\xbb\xbf"
ELEMENTS = "path string, chunk bigint, number bigint, text string, problem string"
_ROWS = 5000


def scan(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(change of depth after each byte, whether each byte stands in a string, state after the last)."""
    view = np.frombuffer(data, np.uint8)
    if not len(view):
        return np.zeros(0, np.int8), np.zeros(0, bool), state
    places = np.arange(len(view))
    # Backslashes in a row right before each byte; a row that began before the chunk counts as its state says.
    last_other = np.maximum.accumulate(np.where(view == 0x5C, -1, places))
    before = np.concatenate([[-1], last_other[:-1]])
    run = places - 1 - before + np.where(before < 0, int(state == ESCAPED), 0)
    inside = (np.cumsum((view == 0x22) & (run % 2 == 0)) + (state != OUTSIDE)) % 2 == 1
    opening, closing = (view == 0x5B) | (view == 0x7B), (view == 0x5D) | (view == 0x7D)
    change = np.where(inside, 0, opening.astype(np.int8) - closing.astype(np.int8)).astype(np.int8)
    if not inside[-1]:
        return change, inside, OUTSIDE
    trailing = len(view) - 1 - last_other[-1] + (int(state == ESCAPED) if last_other[-1] < 0 else 0)
    return change, inside, ESCAPED if trailing % 2 else INSIDE


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    storage = Storage()
    for batch in batches:
        for path, chunk, offset, length in batch[["path", "chunk", "offset", "length"]].itertuples(index=False):
            try:
                _, data = read_range(storage, path, offset, length)
                outcomes = [scan(data, state) for state in range(3)]
                row = (path, chunk, [int(end) for _, _, end in outcomes], [int(change.sum(dtype=np.int64)) for change, _, _ in outcomes], None)
            except Exception as problem:
                row = (path, chunk, None, None, str(problem))
            yield pd.DataFrame([row], columns=["path", "chunk", "states", "depths", "error"])


def _joined(steps: Column) -> Column:
    """The outcomes of consecutive pieces as the outcome of one."""
    nothing = F.struct(F.array(*map(F.lit, range(3))).alias("states"), F.array(*[F.lit(0).cast("bigint")] * 3).alias("depths"))
    return F.aggregate(F.sort_array(steps), nothing, lambda reached, step: F.struct(
        F.transform(reached["states"], lambda state: F.get(step["states"], state)).alias("states"),
        F.zip_with(reached["depths"], reached["states"], lambda depth, state: depth + F.get(step["depths"], state)).alias("depths")))


def _starts(steps: Column, number: str, state: Column, depth: Column) -> Column:
    """State and depth before each of some consecutive pieces, and after the last (with a null number)."""
    place = lambda nth, reached: F.struct(
        nth.cast("bigint").alias(number), reached["state"].alias("state"), reached["depth"].alias("depth"))
    first = F.struct(state.cast("int").alias("state"), depth.cast("bigint").alias("depth"),
                     F.array().cast(f"array<struct<{number}:bigint,state:int,depth:bigint>>").alias("starts"))
    done = F.aggregate(F.sort_array(steps), first, lambda reached, step: F.struct(
        F.get(step["states"], reached["state"]).alias("state"), (reached["depth"] + F.get(step["depths"], reached["state"])).alias("depth"),
        F.array_append(reached["starts"], place(step[number], reached)).alias("starts")))
    return F.array_append(done["starts"], place(F.lit(None), done))


def chunk_starts(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``path, chunk, state, depth`` before each chunk of each file (``path, size``), and after the last with a null ``chunk``;
    a file that can't be read gives a row with an ``error``."""
    seen = write_and_read(plan_chunks(files.select("path", "size"), chunk_bytes).mapInPandas(
        _look, "path string, chunk bigint, states array<int>, depths array<bigint>, error string"), "array-chunks")
    failed = seen.groupBy("path").agg(F.max("error").alias("error")).filter("error IS NOT NULL")
    sound = seen.join(failed, "path", "left_anti").withColumn("block", F.floor(F.col("chunk") / CHUNKS_PER_BLOCK))
    blocks = sound.groupBy("path", "block").agg(F.collect_list(F.struct("chunk", "states", "depths")).alias("steps"))
    whole = blocks.select("path", "block", _joined(F.col("steps")).alias("joined")).groupBy("path").agg(
        F.collect_list(F.struct("block", "joined.states", "joined.depths")).alias("blocks"))
    of_blocks = whole.select("path", F.inline(_starts(F.col("blocks"), "block", F.lit(OUTSIDE), F.lit(0))))
    of_chunks = blocks.join(of_blocks.filter("block IS NOT NULL"), ["path", "block"]).select(
        "path", F.inline(_starts(F.col("steps"), "chunk", F.col("state"), F.col("depth")))).filter("chunk IS NOT NULL")
    ends = of_blocks.filter("block IS NULL").select("path", F.lit(None).cast("bigint").alias("chunk"), "state", "depth")
    return of_chunks.unionByName(ends).withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)


def _rest(handle, at: int, state: int, depth: int) -> tuple[bytes, bytes]:
    """The bytes from ``at`` to the end of the element they are in, and the byte that ends it (none at the end of the file)."""
    parts = []
    handle.seek(at)
    while True:
        data = handle.read(1 << 20)
        if not data:
            return b"".join(parts), b""
        change, inside, end = scan(data, state)
        depths = depth + np.cumsum(change, dtype=np.int64)
        # The element is one level down at least: the first byte that leads out of the array closes it.
        stops = np.flatnonzero((depths == 0) | ((np.frombuffer(data, np.uint8) == 0x2C) & ~inside & (depths == 1)))
        if len(stops):
            parts.append(data[: stops[0]])
            return b"".join(parts), data[stops[0]: stops[0] + 1]
        parts.append(data)
        state, depth = end, int(depths[-1])


def elements_of_range(storage: Storage, path: str, offset: int, length: int, state: int, depth: int) -> Iterator[tuple[str | None, str | None]]:
    """(text of an element, problem) of the elements that begin in a range, whose start is known."""
    with storage.open(path) as handle:
        handle.seek(offset)
        data = handle.read(length)
        head = len(_MARK) if offset == 0 and data.startswith(_MARK) else 0
        if offset == 0 and data[head:].lstrip(_BLANK)[:1] != b"[":
            yield None, "The file is no JSON array"
            return
        change, inside, end = scan(data, state)
        depths = depth + np.cumsum(change, dtype=np.int64)
        view = np.frombuffer(data, np.uint8)
        # What an element follows: the opening bracket of the array, or a comma of the array.
        opens = np.flatnonzero(((view == 0x2C) & ~inside & (depths == 1)) | ((change == 1) & (depths == 1)))
        closes = np.flatnonzero((change == -1) & (depths == 0))
        stops = np.union1d(opens, closes)
        for at in opens:
            nth = int(np.searchsorted(stops, at, side="right"))
            if nth < len(stops):
                raw, stop = data[at + 1: stops[nth]], data[stops[nth]: stops[nth] + 1]
            else:
                more, stop = _rest(handle, offset + len(data), end, int(depths[-1]))
                raw = data[at + 1:] + more
            if stop not in (b",", b"]"):
                yield None, "The array has no end"
                return
            raw = raw.strip(_BLANK)
            if raw:
                try:
                    yield raw.decode(), None
                except UnicodeDecodeError as problem:
                    yield None, str(problem)
            elif (data[at: at + 1], stop) != (b"[", b"]"):
                yield None, "An element of the array is missing"
        # Behind the end of the array nothing but blanks may follow, in this chunk or in a later one.
        after = 0 if depth == 0 and offset else closes[0] + 1 if len(closes) else None
        if after is not None and data[after:].strip(_BLANK):
            yield None, "The file goes on after the array"


def array_elements(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``path, chunk, number, text, problem``: the elements of array files (``path, size``), ordered by chunk and number.

    What isn't JSON gives rows with a ``problem``: a file that is no array, an array without an end or followed by more, an
    element that is missing, no UTF-8, or no JSON itself.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        storage, names = Storage(), ["path", "chunk", "number", "text", "problem"]
        for batch in batches:
            for path, chunk, offset, length, state, depth in batch.itertuples(index=False):
                rows = []
                try:
                    for number, (text, problem) in enumerate(elements_of_range(storage, path, offset, length, state, depth)):
                        rows.append((path, chunk, number, text, problem))
                        if len(rows) == _ROWS:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except Exception as problem:
                    rows.append((path, chunk, None, None, str(problem)))
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"number": "Int64"})

    starts = write_and_read(chunk_starts(files, chunk_bytes), "array-starts")
    chunks = plan_chunks(files.select("path", "size"), chunk_bytes).join(starts.filter("error IS NULL AND chunk IS NOT NULL").drop("error"), ["path", "chunk"])
    found = spread(chunks.select("path", "chunk", "offset", "length", "state", "depth"), "path", "chunk").mapInPandas(read, ELEMENTS)
    no_json = F.when(F.col("problem").isNull() & F.try_parse_json("text").isNull(), "An element is no JSON")
    found = found.withColumn("problem", F.coalesce("problem", no_json))
    open_end = starts.filter("chunk IS NULL AND error IS NULL AND (depth <> 0 OR state <> 0)").select("path", F.lit("The array has no end").alias("problem"))
    failed = starts.filter("error IS NOT NULL").select("path", F.col("error").alias("problem"))
    return found.unionByName(open_end.unionByName(failed), allowMissingColumns=True)
