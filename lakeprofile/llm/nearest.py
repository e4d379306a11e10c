"""Approximate nearest neighbours by cross-polytope hashing.

Each of ``TABLES`` tables turns a unit vector by three rounds of random signs and a Hadamard transform and names its bucket by
the signed axis the result lies closest to. A query looks into the ``PROBES`` buckets of every table whose axes its own image
leans to most, and everything found is ranked by exact distance in double precision on the original vectors.

Vectors of a bucket are dealt into blocks of bounded size, as are the queries that look into it; a task ranks one block
against one block and passes on the best of each query, so neither a full bucket nor pairs are ever gathered. Of equal
vectors only those with the smallest ids can be among the nearest, and only these are indexed. A query that finds too few
looks again, into every bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lakeprofile.llm.common import slim, write_and_read

TABLES = 10
PROBES = 16
ROUNDS = 3
NEAREST = 10
BLOCK_ROWS = 4096
BLOCK_QUERIES = 512
_SEED = 20


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the width is a power of two."""
    count, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(count, width // (2 * step), 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(count, width)
        step *= 2
    return rows


def rotated(rows: np.ndarray, table: int) -> np.ndarray:
    """The images of unit rows in a table, padded to a power of two."""
    width = max(1, 1 << (rows.shape[1] - 1).bit_length())
    rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
    signs = np.random.default_rng([_SEED, table]).choice([-1.0, 1.0], (ROUNDS, width))
    for turn in signs:
        rows = hadamard(rows * turn)
    return rows


def buckets(rows: np.ndarray, table: int, probes: int = 1) -> np.ndarray:
    """The ``probes`` signed axes closest to each row's image, closest first; axis i is i, its opposite width + i."""
    image = rotated(rows, table)
    both = np.concatenate([image, -image], axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _bucket_lists(vector: Column, tables: int, probes: int) -> Column:
    """Per vector an array of ``table * 2**32 + bucket`` numbers; ``probes`` 0 stands for all buckets."""
    @F.pandas_udf("array<long>")
    def run(column: pd.Series) -> pd.Series:
        out = np.empty(len(column), object)
        widths = column.map(len).to_numpy()
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            rows = np.stack([np.asarray(column.iloc[i], float) for i in at])
            rows /= np.abs(rows).max(axis=1, keepdims=True)
            rows /= np.linalg.norm(rows, axis=1, keepdims=True)
            found = np.concatenate([(table << 32) + buckets(rows, table, probes or 1 << 30) for table in range(tables)], axis=1)
            for i, row in zip(at, found):
                out[i] = row
        return pd.Series(out)

    return run(vector)


def usable(vector: Column) -> Column:
    """Whether a vector is there, has only finite components and isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distances(vectors: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; what over- or underflows in squares is scaled first, and is infinite only if the
    distance itself is."""
    with np.errstate(over="ignore", under="ignore"):
        found = np.sqrt(np.square(vectors - vector).sum(axis=1))
        odd = ~np.isfinite(found) | (found < 1e-140)
        if odd.any():
            scale = np.maximum(np.abs(vectors[odd]).max(axis=1), np.abs(vector).max())
            scaled = vectors[odd] / scale[:, None] - vector / scale[:, None]
            most = np.abs(scaled).max(axis=1)
            inner = np.sqrt(np.square(scaled / np.where(most > 0, most, 1)[:, None]).sum(axis=1))
            found[odd] = inner * most * scale
    return found


def _rank(found: DataFrame, nearest: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _search(index: DataFrame, queries: DataFrame, tables: int, probes: int, nearest: int) -> DataFrame:
    """Candidates of each query: ``query_id``, ``vec_id``, ``score``; the best ``nearest`` of each block at least."""
    place = ["width", "bucket"]
    rows = index.select("id", "vector", F.size("vector").alias("width"), F.explode(_bucket_lists(F.col("vector"), tables, 1)).alias("bucket"))
    asked = queries.select("id", "vector", F.size("vector").alias("width"), F.explode(_bucket_lists(F.col("vector"), tables, probes)).alias("bucket"))
    sizes = rows.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("row_blocks")).join(
        asked.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("query_blocks")), place)
    spread = {"row_block": "row_blocks", "query_block": "query_blocks"}

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one block of its own side, meeting every block of the other."""
        return side.join(sizes, place).withColumn(own, F.pmod(F.xxhash64("id"), F.col(spread[own])).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(spread[other]) - 1))).select("id", "vector", *place, "row_block", "query_block")

    keys = [*place, "row_block", "query_block"]

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            ids, vectors = left["id"].to_numpy(), np.stack([np.asarray(v, float) for v in left["vector"]])
            for query, vector in zip(right["id"], right["vector"]):
                distance = distances(vectors, np.asarray(vector, float))
                others = np.flatnonzero(ids != query)
                few = others[np.lexsort((ids[others], distance[others]))[:nearest]]
                parts.append(pd.DataFrame({"query_id": query, "vec_id": ids[few], "score": distance[few]}))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return dealt(rows, "row_block", "query_block").groupBy(*keys).cogroup(
        dealt(asked, "query_block", "row_block").groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")


def nearest_neighbours(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST,
                       tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """For each row that ``is_query`` holds for, its ``nearest`` nearest other rows found: query_id, rank, vec_id, score.

    Nearness is the Euclidean distance, ties go to the smaller id. Rows with a null id, and vectors that are null, empty or
    zero or hold null or non-finite components, take no part; vectors of different widths never meet. Rows that repeat an id
    are one row to the result, with the smaller distance, and never neighbours of their own id. A query with fewer other rows
    than ``nearest`` gets them all; one without any, and an empty table, gives no rows.
    """
    rows = slim(vectors.withColumn("__query", is_query), id=id_col, vector=vector_col, query="__query").filter(
        F.col("id").isNotNull() & usable(F.col("vector")))
    rows = rows.withColumn("id", F.col("id").cast("long"))
    queries = write_and_read(rows.filter("query").select("id", "vector"), "queries")
    # Of equal vectors, one query's own id apart, only the smallest ids can be among the nearest.
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    index = write_and_read(rows.select("id", "vector").distinct().withColumn("nth", nth).filter(F.col("nth") <= nearest + 1).drop("nth"), "index")
    found = write_and_read(_rank(_search(index, queries, tables, probes, nearest), nearest), "found")
    short = queries.join(found.filter(F.col("rank") == nearest).select(F.col("query_id").alias("id")), "id", "left_anti")
    short = write_and_read(short, "short")
    if short.isEmpty():
        return found
    again = _rank(_search(index, short, 1, 0, nearest), nearest)
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
