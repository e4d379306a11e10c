"""The encoding of whole files, told from every byte of them.

A file is cut into chunks of equal size. Whether a chunk is UTF-8 depends on the character that the chunk before was cut in, so
a task reports, for each of the states it may start in, the state it ends in, and which classes of bytes it holds. A small
ordered fold per file joins these: one huge file is many tasks, and a single byte at its end counts.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lakeprofile.functions.encodings import UNDEFINED_IN_1252, encoding_of
from lakeprofile.sources.chunks import CHUNK_BYTES, CHUNKS_PER_BLOCK, plan_chunks
from lakeprofile.sources.storage import Storage

# Between two bytes of UTF-8: at a character's start, one to three continuation bytes to come, or after a lead byte that
# allows only some next bytes. Broken text stays broken.
START, ONE, TWO, THREE, AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4, BROKEN = range(9)
STATES = 9
# Lead bytes and the states they lead to; then, per state inside a character, the bytes it takes and the next state
# (fixed values of the encoding).
LEADS = [(0x00, 0x7F, START), (0xC2, 0xDF, ONE), (0xE0, 0xE0, AFTER_E0), (0xE1, 0xEC, TWO), (0xED, 0xED, AFTER_ED), (0xEE, 0xEF, TWO),
         (0xF0, 0xF0, AFTER_F0), (0xF1, 0xF3, THREE), (0xF4, 0xF4, AFTER_F4)]
FOLLOWS = {ONE: (0x80, 0xBF, START), TWO: (0x80, 0xBF, ONE), THREE: (0x80, 0xBF, TWO), AFTER_E0: (0xA0, 0xBF, ONE), AFTER_ED: (0x80, 0x9F, ONE),
           AFTER_F0: (0x90, 0xBF, TWO), AFTER_F4: (0x80, 0x8F, TWO)}
_UNDEFINED = [bytes.fromhex(code) for code in UNDEFINED_IN_1252.split()]
# Bytes decoded at once.
_STEP = 1 << 20


def step(state: int, byte: int) -> int:
    for low, high, after in (LEADS if state == START else [FOLLOWS[state]] if state in FOLLOWS else []):
        if low <= byte <= high:
            return after
    return BROKEN


def _from_start(data: bytes, at: int) -> int:
    """State after ``data[at:]``, which begins with a character."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        for begin in range(at, len(data), _STEP):
            decoder.decode(data[begin: begin + _STEP])
    except UnicodeDecodeError:
        return BROKEN
    state = START
    for byte in decoder.getstate()[0]:
        state = step(state, byte)
    return state


def utf8_outcomes(data: bytes) -> list[int]:
    """For each state the bytes may start in, the state they end in."""
    if not data:
        return list(range(STATES))
    if data.isascii():
        return [START if state == START else BROKEN for state in range(STATES)]
    known: dict[int, int] = {}
    ends = []
    for state in range(STATES):
        at = 0
        while at < len(data) and state not in (START, BROKEN):
            state = step(state, data[at])
            at += 1
        if state == START and at < len(data):
            if at not in known:
                known[at] = _from_start(data, at)
            state = known[at]
        ends.append(state)
    return ends


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    storage = Storage()
    names = ["path", "chunk", "states", "high", "undefined", "head", "error"]
    for batch in batches:
        for path, chunk, offset, length in batch[["path", "chunk", "offset", "length"]].itertuples(index=False):
            try:
                with storage.open(path) as handle:
                    handle.seek(offset)
                    data = handle.read(length)
                row = (path, chunk, utf8_outcomes(data), not data.isascii(), any(mark in data for mark in _UNDEFINED),
                       data[:4] if chunk == 0 else None, None)
            except Exception as problem:
                row = (path, chunk, None, None, None, None, str(problem))
            yield pd.DataFrame([row], columns=names)


def _joined(steps: Column) -> Column:
    """The outcomes of consecutive pieces as the outcome of one."""
    return F.aggregate(F.sort_array(steps), F.array(*[F.lit(state) for state in range(STATES)]),
                       lambda reached, piece: F.transform(reached, lambda state: F.get(piece["states"], state)))


def whole_encodings(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``path, encoding, confidence, error`` from all bytes of each file (``path``, ``size``).

    An empty file is ASCII. A file that can't be read has an error and no encoding.
    """
    told = plan_chunks(files.select("path", "size"), chunk_bytes).mapInPandas(
        _read, "path string, chunk bigint, states array<int>, high boolean, undefined boolean, head binary, error string")
    classes = [F.bool_or(name).alias(name) for name in ("high", "undefined")] + [F.max(name).alias(name) for name in ("head", "error")]
    blocks = told.groupBy("path", F.floor(F.col("chunk") / CHUNKS_PER_BLOCK).alias("block")).agg(
        _joined(F.collect_list(F.struct("chunk", "states"))).alias("states"), *classes)
    followed = blocks.groupBy("path").agg(_joined(F.collect_list(F.struct("block", "states"))).alias("states"), *classes)
    found = encoding_of(F.hex("head"), F.col("high"), F.get("states", F.lit(START)) == START, F.col("undefined"))
    sound = F.col("error").isNull()
    return followed.select("path", F.when(sound, found).alias("found"), "error").select(
        "path", "found.encoding", "found.confidence", "error")
