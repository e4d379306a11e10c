"""Importance resampling: draws the documents that look most like a target text, with noise so that others get a chance.

Features are runs of words, hashed into buckets. A bucket's gain is the logarithm of how much likelier the target is to use it
than the corpus; a document's weight is the sum of its features' gains, looked up in one array. Weight plus a random
Gumbel term is the score, and the highest scores are the sample, without replacement.

Two passes over the texts: one counts buckets (per task, then a sum), one scores. The scores are written once. No sort and no
window of all rows follows: the score that cuts the sample off is found by bisection, each job an exact count over the
written numbers, then the id that cuts among the rows tied at it. Only the drawn rows are dealt by ranges of the score;
their place in a range plus the sizes of the ranges before is their rank.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakeprofile.llm.common import slim, write_and_read

BUCKETS, NGRAMS, MIN_WORDS, PERCENT = 10_000, (1, 1), 20, 10
#: Levels of the bisection that one job counts: 2**LEVELS - 1 thresholds.
LEVELS = 3
#: Distinct features whose bucket a task remembers before it starts anew.
_REMEMBERED = 200_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LAST = (1 << 63) - 1


class Buckets(dict):
    """Bucket by feature, worked out when first asked for."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % self.buckets
        return bucket


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z, and no other letters, lower-cased."""
    return _WORD.findall((text or "").encode().lower())  # bytes.lower() changes A-Z only


def features_of(words: list[bytes], ngrams: tuple[int, int]) -> Iterable[bytes]:
    if ngrams == (1, 1):
        return words
    return (b" ".join(words[i: i + n]) for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(words) - n + 1))


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, ngrams: tuple[int, int] = NGRAMS) -> DataFrame:
    """``bucket`` and ``n``: features of all texts by bucket. A task sends at most one row per bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, totals = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = np.fromiter(map(known.__getitem__, features_of(words_of(text.as_py()), ngrams)), np.int64)
                totals += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[used])], ["bucket", "n"])

    return slim(docs, text=text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _totals(counts: DataFrame, buckets: int) -> np.ndarray:
    totals = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():  # one row per bucket at most
        totals[bucket] = n
    return totals


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, a thousand times the logarithm of its smoothed share of the target over that of the corpus, rounded down."""
    buckets = len(corpus)
    all_corpus, all_target = float(corpus.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * all_corpus / ((s + 1) * all_target)))
                     for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def scores(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, seed: str, ngrams: tuple[int, int]) -> DataFrame:
    """``id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(gain))
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                found = np.fromiter(map(known.__getitem__, features_of(words, ngrams)), np.int64)
                n_words.append(len(words))
                n_features.append(len(found))
                weights.append(int(gain[found].sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), *[pa.array(c, pa.int64()) for c in (n_words, n_features, weights)]],
                ["id", "h", "n_words", "n_features", "weight"])

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    rows = slim(docs, id=id_col, text=text_col).select("id", h.alias("h"), "text")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, h long, n_words long, n_features long, weight long"
    noise = F.floor(F.lit(-1000) * F.log(-F.log((F.col("h") + 0.5) / F.lit(4294967296.0))))
    return rows.mapInArrow(run, schema).select("id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def _bisect(rows: DataFrame, column: str, wanted: int, low: int, high: int) -> tuple[int, int]:
    """The least value v in low..high with at least ``wanted`` rows of ``column`` at most v, and the count of rows below v.

    Each job counts exactly, at the middles of the next ``LEVELS`` halvings at once.
    """
    below = 0  # rows under low
    while low < high:
        middles: list[int] = []
        parts = [(low, high)]
        for _ in range(LEVELS):
            parts = [(a, b) for a, b in parts if a < b]
            at = [(a + b) // 2 for a, b in parts]
            middles += at
            parts = [half for (a, b), m in zip(parts, at) for half in ((a, m), (m + 1, b))]
        counted = rows.agg(*[F.count_if(F.col(column) <= m).alias(f"m{i}") for i, m in enumerate(middles)]).first()
        counts = dict(zip(middles, counted))
        for _ in range(LEVELS):
            middle = (low + high) // 2
            if low == high or middle not in counts:
                break
            if counts[middle] >= wanted:
                high = middle
            else:
                low, below = middle + 1, counts[middle]
    return low, below


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             percent: int = PERCENT, seed: str = "2024", buckets: int = BUCKETS, ngrams: tuple[int, int] = NGRAMS,
             min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_features``, ``weight``, ``score`` and ``rank``.

    Of the rows with at least ``min_words`` words, ``percent`` in a hundred, rounded down, are drawn by the highest score and
    ranked from 1; ties go to the smaller id, null ids last. Rows that repeat an id and a score are told apart by where they
    stand in the written table. Other rows have a null rank. Null and empty texts have no words: weight 0. An empty target or
    an empty table is fine: every gain is then of an unused bucket, or there are no rows. Further columns are left out.
    """
    gain = gains(_totals(bucket_counts(docs, text_col, buckets, ngrams), buckets), _totals(bucket_counts(target, target_col, buckets, ngrams), buckets))
    scored = write_and_read(
        scores(docs, gain, id_col, text_col, seed, ngrams)
        .select("*", (-F.col("score")).alias("down"), F.coalesce(F.col("id").cast("long"), F.lit(_LAST)).alias("tie"), F.monotonically_increasing_id().alias("row")),
        "resampling_scores")
    eligible = scored.filter(F.col("n_words") >= min_words)
    n, low, high = eligible.agg(F.count("*"), F.min("down"), F.max("down")).first()
    wanted = percent * n // 100
    drawn = F.lit(False)
    if wanted:
        cut, above = _bisect(eligible, "down", wanted, low, high)
        tied = eligible.filter(F.col("down") == cut)
        ties = tied.agg(F.min("tie"), F.max("tie")).first()
        last, _ = _bisect(tied, "tie", wanted - above, *ties)
        drawn = (F.col("n_words") >= min_words) & ((F.col("down") < cut) | ((F.col("down") == cut) & (F.col("tie") <= last)))
    others = scored.filter(~drawn).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if not wanted:
        return others

    # The number that Spark gives a row after the sort holds its range (upper bits) and its place in it (lower 33 bits).
    ranges = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted // 10_000 + 1))
    dealt = write_and_read(
        scored.filter(drawn).repartitionByRange(ranges, "down", "tie", "row").sortWithinPartitions("down", "tie", "row")
        .withColumn("place", F.monotonically_increasing_id()), "resampling_drawn")
    dealt = dealt.withColumn("part", F.shiftright("place", 33))
    before, total = [], 0
    for number, size in sorted(dealt.groupBy("part").count().collect()):  # one row per range
        before.append((number, total))
        total += size
    offsets = F.broadcast(docs.sparkSession.createDataFrame(before, "part long, before long"))  # so many rows as ranges
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    # Only rows that repeat an id and a score at the very cut can be more than wanted.
    ranked = dealt.join(offsets, "part").select("id", "n_features", "weight", "score", rank.alias("rank"))
    return others.unionByName(ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))))
