"""Delimited files cut into parts at record starts.

Where a record starts depends on the quotes before it. Each chunk of a file is looked at alone: for every state it may start in, a
task reports the state it ends in and where the first record after its start begins. An ordered fold then tells the true
states, and each part is written by its own task: the bytes from one record start to another, below the header.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lakeprofile.session import spread, write_and_read
from lakeprofile.sources.chunks import (
    CHUNKS_PER_BLOCK, CR, LF, QUOTE_SEEN, QUOTED, RECORD_START, byte_order, chunk_outcomes, line_ends, plan_chunks, read_range, walk,
)
from lakeprofile.sources.storage import Storage, join_path

PART_BYTES = 128 * 1024 * 1024
STATES = 5
_COPY = 1 << 20
PARTS = "path string, part bigint, written string, bytes bigint, error string"


def first_record_start(lead: bytes, data: bytes, delimiter: bytes, state: int, ends: np.ndarray | None = None) -> int | None:
    """Place in ``data`` of the first record that starts in it, if it begins in ``state``."""
    ends = line_ends(lead, data) if ends is None else ends
    at = 1 if data[:1] == b"\n" and lead[-1:] == b"\r" and state != QUOTED else 0
    if state == RECORD_START:
        return at if at < len(data) else None
    while at < len(data):
        if state == QUOTED:
            quote = data.find(b'"', at)
            if quote < 0:
                return None
            state, at = QUOTE_SEEN, quote + 1
            continue
        nth = int(np.searchsorted(ends, at))
        if nth == len(ends):
            return None
        end = int(ends[nth])
        state = walk(state, data[at:end], delimiter)
        at = end + (2 if data[end] == CR and data[end + 1: end + 2] == b"\n" else 1)
        if state != QUOTED:
            return at if at < len(data) else None
    return None


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    storage = Storage()
    for batch in batches:
        for path, encoding, delimiter, chunk, offset, length in batch[["path", "encoding", "delimiter", "chunk", "offset", "length"]].itertuples(index=False):
            try:
                codec, mark = byte_order(encoding, storage, path)
                if codec:
                    raise ValueError(f"{encoding} files are not split")
                lead, data = read_range(storage, path, offset, length)
                mark = mark if offset == 0 else 0
                lead, data = (b"", data[mark:]) if mark else (lead, data)
                separator, ends = (delimiter or ",").encode(), line_ends(lead, data)
                firsts = [first_record_start(lead, data, separator, state, ends) for state in range(STATES)]
                # A mark belongs to the record behind it.
                begins = [None if first is None else offset + (mark + first if first else 0) for first in firsts]
                row = (path, chunk, [state for state, _ in chunk_outcomes(lead, data, separator)], begins, None)
            except Exception as problem:
                row = (path, chunk, None, None, str(problem))
            yield pd.DataFrame([row], columns=["path", "chunk", "states", "begins", "error"])


def _followed(steps: Column, state: Column) -> Column:
    """Where each of some consecutive chunks' first record begins, and the state after them, from the state before."""
    nothing = F.struct(state.cast("int").alias("state"), F.array().cast("array<struct<chunk:bigint,begin:bigint>>").alias("begins"))
    return F.aggregate(F.sort_array(steps), nothing, lambda reached, step: F.struct(
        F.get(step["states"], reached["state"]).alias("state"),
        F.array_append(reached["begins"], F.struct(step["chunk"].alias("chunk"), F.get(step["begins"], reached["state"]).alias("begin"))).alias("begins")))


def _joined(steps: Column) -> Column:
    return F.aggregate(F.sort_array(steps), F.array(*map(F.lit, range(STATES))),
                       lambda reached, step: F.transform(reached, lambda state: F.get(step["states"], state)))


def record_parts(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``path, part, begin, end, error``: byte ranges that start with a record and end before one.

    Files come with ``path, size, encoding, delimiter``. Every byte of a file is in one part; a part holds the records that start
    in its share of the bytes, so a record longer than a share leaves shares without a part. Files with wide characters and
    files that can't be read give one row with an ``error``.
    """
    seen = write_and_read(plan_chunks(files.select("path", "size", "encoding", "delimiter"), part_bytes).mapInPandas(
        _look, "path string, chunk bigint, states array<int>, begins array<bigint>, error string"), "record-starts")
    failed = seen.groupBy("path").agg(F.max("error").alias("error")).filter("error IS NOT NULL")
    sound = seen.join(failed, "path", "left_anti").withColumn("block", F.floor(F.col("chunk") / CHUNKS_PER_BLOCK))
    blocks = sound.groupBy("path", "block").agg(F.collect_list(F.struct("chunk", "states", "begins")).alias("steps"))
    # The state that each block starts in: one row per block and file is all that meets here.
    ends = blocks.select("path", "block", _joined(F.col("steps")).alias("states")).groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("block", "states"))).alias("blocks"))
    started = F.aggregate(
        "blocks", F.struct(F.lit(RECORD_START).alias("state"), F.array().cast("array<struct<block:bigint,state:int>>").alias("starts")),
        lambda reached, step: F.struct(
            F.get(step["states"], reached["state"]).alias("state"),
            F.array_append(reached["starts"], F.struct(step["block"].alias("block"), reached["state"].alias("state"))).alias("starts")))
    starts = ends.select("path", F.inline(started["starts"]))
    begins = blocks.join(starts, ["path", "block"]).select("path", F.inline(_followed(F.col("steps"), F.col("state"))["begins"])).filter("begin IS NOT NULL")
    behind = Window.partitionBy("path").orderBy(F.desc("chunk"))
    parts = begins.join(files.select("path", "size"), "path").select(
        "path", F.col("chunk").alias("part"), "begin", F.coalesce(F.lag("begin").over(behind), "size").alias("end"), F.lit(None).cast("string").alias("error"))
    return parts.unionByName(failed, allowMissingColumns=True)


def _header(handle, size: int, mark: int, delimiter: bytes) -> bytes:
    """The first record of a file, its line end included."""
    data = b""
    handle.seek(mark)
    while mark + len(data) < size:
        more = handle.read(_COPY)
        if not more:
            break
        data += more
        ends = line_ends(b"", data)
        state, at = RECORD_START, 0
        for end in ends:
            state = walk(state, data[at:end], delimiter)
            at = int(end) + 1
            if state != QUOTED:
                at += data[at - 1] == CR and data[at: at + 1] == b"\n"
                return data[:at]
    return data


def split_delimited(files: DataFrame, folder: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Writes each file as parts of whole records to ``folder`` and tells what was written (``path, part, written, bytes, error``).

    Files come with ``path, size, encoding, delimiter, has_header``. Parts are named after their file and number, so that a task
    that runs again writes the same file again; they begin with the header where there is one. Without the repeated headers,
    the parts of a file in the order of their numbers are its bytes.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        storage = Storage()
        for batch in batches:
            for path, part, begin, end, error, size, encoding, delimiter, has_header, tag in batch.itertuples(index=False):
                if error:
                    yield pd.DataFrame([(path, None, None, None, error)], columns=_names).astype({"part": "Int64", "bytes": "Int64"})
                    continue
                name = path.rsplit("/", 1)[1]
                stem, dot, ending = name.rpartition(".")
                target = join_path(folder, f"{stem or name}-{tag}-{int(part):08d}{dot}{ending if dot else ''}")
                file_system, inner = storage.locate(target)
                file_system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with storage.open(path) as source, file_system.open_output_stream(inner) as out:
                    if has_header and begin > 0:
                        out.write(_header(source, size, byte_order(encoding, storage, path)[1], (delimiter or ",").encode()))
                    source.seek(int(begin))
                    left = int(end) - int(begin)
                    while left:
                        block = source.read(min(_COPY, left))
                        if not block:
                            raise OSError(f"{path} is shorter than it was")
                        out.write(block)
                        left -= len(block)
                yield pd.DataFrame([(path, part, target, int(end) - int(begin), None)], columns=_names).astype({"part": "Int64", "bytes": "Int64"})

    _names = [field.split()[0] for field in PARTS.split(", ")]
    # Files of one name in several folders stay apart by a tag of their path.
    planned = record_parts(files, part_bytes).join(
        files.select("path", "size", "encoding", "delimiter", "has_header", F.lower(F.hex(F.crc32("path"))).alias("tag")), "path")
    planned = planned.select("path", "part", "begin", "end", "error", "size", "encoding", "delimiter", "has_header", "tag")
    return write_and_read(spread(planned, "path", "part").mapInPandas(write, PARTS), "split-parts")
