"""Deletion vectors of Delta tables: the positions of rows that no longer count.

A vector is a set of row positions, stored as compressed bitmaps (the portable Roaring format) in a file of its own or as text
in the log. Each vector is decoded in the task that reads it, and its positions leave as rows, so that the join that drops
them is Spark's.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lakeprofile.session import spread
from lakeprofile.sources.storage import Storage, join_path

VECTOR = "struct<storageType:string,pathOrInlineDv:string,offset:int,sizeInBytes:int,cardinality:bigint>"
# Marks of the formats (fixed values).
PORTABLE_ARRAY = 1681511377
WITHOUT_RUNS, WITH_RUNS = 12346, 12347
OFFSETS_FROM, LARGEST_LIST, BITMAP_BYTES = 4, 4096, 8192
#: Characters of an encoded file id at the end of a relative name.
_ID_CHARS = 20
#: Positions handed to Spark at once.
_BATCH = 100_000


class BrokenVector(ValueError):
    """A vector that can't be decoded: rows it deletes would come back, so nothing is read."""


def bitmap_values(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """The sorted values of one 32-bit bitmap that starts at ``at``, and where it ends."""
    mark, = struct.unpack_from("<I", data, at)
    at += 4
    if mark & 0xFFFF == WITH_RUNS:
        containers = (mark >> 16) + 1
        flags = np.unpackbits(np.frombuffer(data, np.uint8, (containers + 7) // 8, at), bitorder="little")[:containers].astype(bool)
        at += (containers + 7) // 8
        has_offsets = containers >= OFFSETS_FROM
    elif mark == WITHOUT_RUNS:
        containers, = struct.unpack_from("<I", data, at)
        at += 4
        flags, has_offsets = np.zeros(containers, bool), True
    else:
        raise BrokenVector(f"unknown bitmap mark {mark}")
    header = np.frombuffer(data, "<u2", 2 * containers, at).astype(np.int64).reshape(-1, 2)
    at += 4 * containers + (4 * containers if has_offsets else 0)
    found = []
    for (key, size), runs in zip(header, flags):
        if runs:
            count, = struct.unpack_from("<H", data, at)
            pairs = np.frombuffer(data, "<u2", 2 * count, at + 2).astype(np.int64).reshape(-1, 2)
            at += 2 + 4 * count
            lengths = pairs[:, 1] + 1
            values = np.repeat(pairs[:, 0] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        elif size + 1 > LARGEST_LIST:
            values = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, BITMAP_BYTES, at), bitorder="little"))
            at += BITMAP_BYTES
        else:
            values = np.frombuffer(data, "<u2", size + 1, at).astype(np.int64)
            at += 2 * (size + 1)
        found.append(values + (key << 16))
    return (np.concatenate(found) if found else np.zeros(0, np.int64)), at


def vector_positions(data: bytes) -> np.ndarray:
    """Row positions of a serialised vector: bitmaps of 32-bit values, one for each upper half that occurs."""
    try:
        mark, bitmaps = struct.unpack_from("<iQ", data, 0)
        if mark != PORTABLE_ARRAY:
            raise BrokenVector(f"unknown vector mark {mark}")
        at, found = 12, []
        for _ in range(bitmaps):
            upper, = struct.unpack_from("<I", data, at)
            values, at = bitmap_values(data, at + 4)
            found.append(values + (upper << 32))
    except (struct.error, ValueError) as problem:
        raise BrokenVector(f"The deletion vector can't be decoded: {problem}") from problem
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def vector_bytes(storage: Storage, root: str, kind: str, place: str, offset: int | None, size: int) -> bytes:
    """A vector's serialised form, from the log's text or from its file, whose checksum must hold."""
    if kind == "i":
        return base64.z85decode(place)[:size]
    if kind == "u":
        name = f"deletion_vector_{uuid.UUID(bytes=base64.z85decode(place[-_ID_CHARS:]))}.bin"
        folder = place[:-_ID_CHARS]
        path = join_path(join_path(root, folder), name) if folder else join_path(root, name)
    elif kind == "p":
        path = place
    else:
        raise BrokenVector(f"unknown kind of deletion vector: {kind}")
    with storage.open(path) as handle:
        handle.seek(offset if offset is not None else 1)
        told, = struct.unpack(">i", handle.read(4))
        data = handle.read(size)
        checksum, = struct.unpack(">I", handle.read(4))
    if told != size or len(data) != size or checksum != zlib.crc32(data):
        raise BrokenVector(f"The deletion vector in {path} is damaged")
    return data


def deleted_rows(files: DataFrame) -> DataFrame:
    """``path, row_index`` of each deleted row of data files (``table_root``, ``path``, ``vector``).

    A vector that can't be read, or holds another number of positions than the log says, fails the job.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        storage = Storage()
        for batch in batches:
            for root, path, kind, place, offset, size, cardinality in batch.itertuples(index=False):
                offset = None if pd.isna(offset) else int(offset)
                positions = vector_positions(vector_bytes(storage, root, kind, place, offset, int(size)))
                if not pd.isna(cardinality) and len(positions) != int(cardinality):
                    raise BrokenVector(f"The deletion vector of {path} holds {len(positions)} rows, the log says {int(cardinality)}")
                for at in range(0, len(positions), _BATCH):
                    part = positions[at: at + _BATCH]
                    yield pd.DataFrame({"path": [path] * len(part), "row_index": part})

    marked = files.filter("vector IS NOT NULL").select(
        "table_root", "path", *[F.col(f"vector.{name}") for name in ("storageType", "pathOrInlineDv", "offset", "sizeInBytes", "cardinality")])
    return spread(marked, "path").mapInPandas(read, "path string, row_index bigint")
