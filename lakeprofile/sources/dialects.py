"""The delimiter of delimited files, told from every record.

A task counts its byte range for both answers to the one question it can't settle alone: whether it begins inside quotes.
For each delimiter it reports how many whole records have how many fields, and what the pieces at its two ends hold. The
number of quotes before a range settles its start; pieces of a record that reaches over several ranges are added up; the
histograms are then plain sums per file, delimiter and field count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lakeprofile.lookups import DIALECT_SAMPLE_CHARS
from lakeprofile.session import write_and_read
from lakeprofile.sources.chunks import CHUNK_BYTES, CR, LF, QUOTE, byte_order, narrow, plan_chunks, read_range
from lakeprofile.sources.delimited import AGREEMENT, DELIMITERS
from lakeprofile.sources.storage import Storage

_BLANKS = np.zeros(256, bool)
_BLANKS[[9, 11, 12, CR, LF, 32]] = True
_FOUND = "path string, chunk bigint, quotes bigint, inside boolean, piece int, delimiter string, delimiters bigint, filled boolean, records bigint, error string"
#: Pieces of a range: what stands before its first record end, whole records, what stands after the last record end.
HEAD, WHOLE, TAIL = range(3)


def range_histogram(data: bytes, inside: bool) -> list[tuple[int, str, int, bool, int]]:
    """``(piece, delimiter, delimiters outside quotes, holds more than blanks, how many)`` of a range that begins inside quotes or not.

    A range without a record end is one head.
    """
    view = np.frombuffer(data, np.uint8)
    quotes = view == QUOTE
    outside = np.logical_xor.accumulate(quotes) == inside if len(view) else np.empty(0, bool)
    ends = np.flatnonzero(((view == LF) | (view == CR)) & outside)
    edges = np.concatenate([[0], ends + 1, [len(view)]])
    filled_before = np.concatenate([[0], np.cumsum(~_BLANKS[view])])
    filled = np.diff(filled_before[edges]) > 0
    rows = []
    for delimiter in DELIMITERS:
        at = np.flatnonzero((view == ord(delimiter)) & outside)
        # A delimiter that is blank itself doesn't fill a record.
        counts = np.diff(np.searchsorted(at, edges))
        rows.append((HEAD, delimiter, int(counts[0]), bool(filled[0]), 1))
        if len(ends):
            rows.append((TAIL, delimiter, int(counts[-1]), bool(filled[-1]), 1))
            values, times = np.unique(counts[1:-1][filled[1:-1]], return_counts=True)
            rows += [(WHOLE, delimiter, int(value), True, int(n)) for value, n in zip(values, times)]
    return rows


def _histograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [field.split()[0] for field in _FOUND.split(", ")]
    storage = Storage()
    for batch in batches:
        for path, encoding, chunk, offset, length in batch[["path", "encoding", "chunk", "offset", "length"]].itertuples(index=False):
            try:
                codec, mark = byte_order(encoding, storage, path)
                _, data = narrow(*read_range(storage, path, offset, length), offset, codec, mark)
                rows = [(path, chunk, data.count(b'"'), inside, *row, None)
                        for inside in ((False, True) if chunk else (False,)) for row in range_histogram(data, inside)]
            except Exception as problem:
                rows = [(path, chunk, 0, False, HEAD, None, 0, False, 0, str(problem))]
            yield pd.DataFrame(rows, columns=names)


def field_counts(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``path, delimiter, fields, records``: how many records of each file have how many fields under each delimiter.

    Files come with ``path, size, encoding``. Blank records don't count; delimiters and line breaks between quotes are text.
    Files that can't be read are left out.
    """
    found = write_and_read(plan_chunks(files.select("path", "size", "encoding"), chunk_bytes).mapInPandas(_histograms, _FOUND), "field-counts")
    in_order = Window.partitionBy("path").orderBy("chunk")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: the quotes before it tell where it begins, the record ends before it number the record that its head is part of.
    starts = found.groupBy("path", "chunk").agg(F.max("quotes").alias("quotes")).select(
        "path", "chunk", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    true = found.filter("error is null").join(starts, ["path", "chunk", "inside"])
    numbered = true.groupBy("path", "chunk").agg(F.max((F.col("piece") == TAIL).cast("int")).alias("ended")).select(
        "path", "chunk", F.coalesce(F.sum("ended").over(before), F.lit(0)).alias("record"))
    pieces = true.filter(F.col("piece") != WHOLE).join(numbered, ["path", "chunk"]).groupBy(
        "path", "delimiter", (F.col("record") + (F.col("piece") == TAIL).cast("int")).alias("record")).agg(
        F.sum("delimiters").alias("delimiters"), F.bool_or("filled").alias("filled"))
    broken = found.filter("error is not null").select("path").distinct()
    counted = true.filter(F.col("piece") == WHOLE).select("path", "delimiter", "delimiters", "records").unionByName(
        pieces.filter("filled").select("path", "delimiter", "delimiters", F.lit(1).cast("bigint").alias("records")))
    return counted.join(broken, "path", "left_anti").groupBy("path", "delimiter", (F.col("delimiters") + 1).alias("fields")).agg(
        F.sum("records").alias("records"))


def whole_dialects(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``path, told``: the delimiter that most records of each file agree on, null where none splits them alike.

    For each delimiter the field count of most records is taken. The one whose count holds for the largest share of records
    wins, then the one with more fields, then the order of ``DELIMITERS``.
    """
    counts = field_counts(files, chunk_bytes)
    best = counts.groupBy("path", "delimiter").agg(
        F.sum("records").alias("all"),
        F.max(F.when(F.col("fields") > 1, F.struct("records", "fields"))).alias("most"))
    share = F.col("most.records") / F.col("all")
    rank = F.array_position(F.array(*map(F.lit, DELIMITERS)), F.col("delimiter"))
    good = F.when(share >= AGREEMENT, F.struct(share.alias("share"), F.col("most.fields").alias("fields"), (-rank).alias("rank"), "delimiter"))
    return best.groupBy("path").agg(F.max(good)["delimiter"].alias("told"))


def with_dialects(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``files`` with ``told``, the delimiter of all records; null for files that their first characters hold whole."""
    longer = files.filter(F.col("size") > DIALECT_SAMPLE_CHARS)
    return files.join(whole_dialects(longer, chunk_bytes), "path", "left")
