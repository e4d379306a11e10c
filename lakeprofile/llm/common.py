"""What several operators share: materialising, checked broadcasts, word splitting, hashing of byte windows."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakeprofile.session import scratch_path, write_and_read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows a side of a join may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

__all__ = ["BROADCAST_ROWS", "ascii_lower", "checked_broadcast", "per_process", "read_table", "scratch_path", "slim", "write_and_read"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked_broadcast(df: DataFrame, label: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` materialised, with a broadcast hint only if it was counted to hold at most ``max_rows`` rows."""
    kept = write_and_read(df, label)
    return F.broadcast(kept) if kept.limit(max_rows + 1).count() <= max_rows else kept


def slim(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under names of our own, so that further columns of the input can't clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def per_process(key: str, make: Callable):
    """What ``make`` returns, made once in each worker process: tasks that follow each other in one share it.

    Only for what can be made again at any time, such as a tokenizer with what it has encoded. Task functions travel by
    value, so their own modules start anew with every task; the process's module table doesn't.
    """
    kept = sys.modules.setdefault("_lakeprofile_process", types.ModuleType("_lakeprofile_process")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    return F.translate(text, UPPER, LOWER)


# ---------------------------------------------------------------------------------------------------------------------
# Byte windows. A window's value is a polynomial over 2**64 with an odd base, so that all windows of a buffer come from
# one running sum, and a shift is undone with the base's inverse.

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``size`` of each."""
    size = max(1 << 12, 1 << (size - 1).bit_length())
    if size not in _tables:
        if len(_tables) > 4:
            _tables.clear()
        both = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, np.uint64(base), np.uint64)
            table[0] = 1
            both.append(np.multiply.accumulate(table))
        _tables[size] = both[0], both[1]
    return _tables[size]


def mix(values: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def running(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of ``data`` (uint8), one longer than it."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data) + 1)[0][: len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value for the bytes of each span."""
    return mix((sums[ends] - sums[starts]) * _powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def byte_views(column) -> list[np.ndarray | None]:
    """The UTF-8 bytes of each value of an Arrow string column, without copies; None for null."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    valid = column.is_valid().to_pylist() if column.null_count else [True] * len(column)
    return [data[offsets[i]: offsets[i + 1]] if valid[i] else None for i in range(len(column))]


def connected(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, component) per node, the component being its smallest node.

    Rounds of large-star and small-star steps: every node's neighbours are tied to the smallest one it sees, until nothing
    changes. Minima are partial aggregates and the joins plain equi-joins, so a node with very many neighbours is no single
    task's work. Each round is written to the shared scratch folder; only its row count and a checksum reach the driver.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # pairs: (u, v), u sees v.
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        tied = pairs.join(least, "u")
        if large:
            return tied.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return tied.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).filter("a != b")

    current = write_and_read(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    checksum = None
    while True:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        larger = star(both, True).filter("a != b").distinct()
        current = write_and_read(star(larger.select(F.col("a").alias("u"), F.col("b").alias("v")), False).distinct(), label)
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == checksum:
            break
        checksum = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b"), F.col("b")).distinct())
