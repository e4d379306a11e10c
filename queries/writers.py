"""Files Spark has no writer for, written from a table by the tasks that hold its rows."""

from __future__ import annotations

import base64
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lakeprofile.sources.storage import Storage, join_path

ROWS_PER_FILE = 5000
SPREADSHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def _cell(value) -> str:
    if isinstance(value, str):
        return f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'
    return f"<c><v>{value}</v></c>"


def workbook_bytes(frame: pd.DataFrame) -> bytes:
    rows = [list(frame.columns), *frame.itertuples(index=False)]
    sheet = "".join(f"<row>{''.join(_cell(value) for value in row)}</row>" for row in rows)
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{SPREADSHEET}" xmlns:r="{DOCUMENT}"><sheets>'
                                         '<sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" '
                                                    'Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml",
                      f'<worksheet xmlns="{SPREADSHEET}"><sheetData>{sheet}</sheetData></worksheet>')
    return content.getvalue()


def write_files(df: DataFrame, folder: str, suffix: str, render: Callable[[pd.DataFrame], bytes]) -> None:
    """One file per few thousand rows of each partition."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        storage = Storage()
        number = 0
        for batch in batches:
            for start in range(0, len(batch), ROWS_PER_FILE):
                # A task that runs again writes the same names again.
                path = join_path(folder, f"part-{TaskContext.get().partitionId()}-{number}{suffix}")
                number += 1
                file_system, inner = storage.locate(path)
                file_system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with file_system.open_output_stream(inner) as handle:
                    handle.write(render(batch.iloc[start:start + ROWS_PER_FILE]))
                yield pd.DataFrame({"path": [path]})

    df.mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()


def write_workbooks(df: DataFrame, folder: str) -> None:
    write_files(df, folder, ".xlsx", workbook_bytes)


def bitmap_bytes(values: np.ndarray, runs: bool = False) -> bytes:
    """Sorted 32-bit values as a portable compressed bitmap: lists, bit sets, or runs."""
    keys, starts = np.unique(values >> 16, return_index=True)
    groups = np.split(values & 0xFFFF, starts[1:])
    header, bodies = b"", []
    for key, group in zip(keys, groups):
        header += struct.pack("<HH", key, len(group) - 1)
        if runs:
            edges = np.flatnonzero(np.diff(group) != 1) + 1
            spans = [(span[0], len(span) - 1) for span in np.split(group, edges)]
            bodies.append(struct.pack("<H", len(spans)) + b"".join(struct.pack("<HH", *span) for span in spans))
        elif len(group) > 4096:
            bits = np.zeros(1 << 16, np.uint8)
            bits[group] = 1
            bodies.append(np.packbits(bits, bitorder="little").tobytes())
        else:
            bodies.append(group.astype("<u2").tobytes())
    if runs:
        flags = np.packbits(np.ones(len(keys), np.uint8), bitorder="little").tobytes()
        start = struct.pack("<I", (len(keys) - 1) << 16 | 12347) + flags
    else:
        start = struct.pack("<II", 12346, len(keys))
    offsets, at = b"", len(start) + len(header) + 4 * len(keys)
    for body in bodies:
        offsets += struct.pack("<I", at)
        at += len(body)
    return start + header + (b"" if runs and len(keys) < 4 else offsets) + b"".join(bodies)


def vector_bytes(positions: np.ndarray, runs: bool = False) -> bytes:
    """Sorted row positions as a deletion vector: one bitmap for each upper half."""
    uppers, starts = np.unique(positions >> 32, return_index=True)
    groups = np.split(positions & 0xFFFFFFFF, starts[1:]) if len(positions) else []
    return struct.pack("<iQ", 1681511377, len(groups)) + b"".join(
        struct.pack("<I", upper) + bitmap_bytes(group, runs) for upper, group in zip(uppers, groups))


def vector_text(data: bytes) -> str:
    return base64.z85encode(data + bytes(-len(data) % 4)).decode()


def write_vectors(deleted: DataFrame, root: str) -> DataFrame:
    """A deletion vector for each data file of ``path, row_index`` rows: ``path`` and the vector as the log names it.

    Vectors take turns: in a file of their own, in a file below a folder, or in the log.
    """
    def make(frame: pd.DataFrame) -> pd.DataFrame:
        path = frame["path"].iloc[0]
        positions = np.sort(frame["row_index"].to_numpy())
        turn = zlib.crc32(path.rsplit("/", 1)[1].encode()) % 3
        data = vector_bytes(positions, runs=turn == 0)
        if turn == 2:
            row = ("i", vector_text(data), None)
        else:
            name = uuid.uuid5(uuid.NAMESPACE_URL, path)
            folder = "ab" if turn else ""
            where = join_path(join_path(root, folder), f"deletion_vector_{name}.bin") if folder else join_path(root, f"deletion_vector_{name}.bin")
            storage = Storage()
            file_system, inner = storage.locate(where)
            file_system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with file_system.open_output_stream(inner) as handle:
                handle.write(b"\x01" + struct.pack(">i", len(data)) + data + struct.pack(">I", zlib.crc32(data)))
            row = ("u", folder + vector_text(name.bytes), 1)
        return pd.DataFrame([(path, *row, len(data), len(positions))], columns=["path", "kind", "place", "offset", "size", "rows"]).astype({"offset": "Int32"})

    return deleted.groupBy("path").applyInPandas(make, "path string, kind string, place string, offset int, size int, rows bigint")
