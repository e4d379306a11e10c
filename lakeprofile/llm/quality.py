"""Scores the quality of texts with a classifier learned from trusted good texts and unlabelled web text.

Features describe the whole text: kinds of characters, lengths and repetition of words and lines, and the worst stretch of each
kind. A small network is trained to minimise the non-negative unbiased risk of positive-unlabelled learning: good texts count
with the class prior, unlabelled ones as not good, less what the good ones among them contribute; where that difference falls
below zero the step goes back instead, so that the network can't learn the unlabelled texts by heart. The prior is estimated
from good and unlabelled texts alone (see ``estimated_prior``). Training uses bounded samples (``POSITIVES`` and ``UNLABELLED`` rows, drawn by a hash of the id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakeprofile.llm.common import checked_broadcast, running, slim, spans_hash

POSITIVES = 6000
UNLABELLED = 12000
SEGMENTS = 8
HIDDEN = 24
EPOCHS = 60
_BATCH = 512
_RATE = 0.005
_SEED = 3
_NEWTON = 12
_RIDGE = 1e-4
_SIGNS = np.frombuffer(b"!#$%&*|-_<>{}[]=/@\"'():;?+^~.,", np.uint8)


def _share(part: float, whole: float) -> float:
    return float(part) / whole if whole else 0.0


def _repetition(values: np.ndarray) -> tuple[float, float]:
    """Share of distinct values, and share of the most frequent."""
    if not len(values):
        return 0.0, 0.0
    counts = np.unique(values, return_counts=True)[1]
    return len(counts) / len(values), counts.max() / len(values)


def features(data: np.ndarray) -> np.ndarray:
    """The description of one text, given as UTF-8 bytes."""
    size = len(data)
    counts = np.bincount(data, minlength=256)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    beyond, blanks, lines = counts[128:].sum(), counts[32] + counts[9:14].sum(), counts[10]
    out = [np.log1p(size), _share(upper, upper + lower), _share(lower + upper + beyond, size), _share(digits, size), _share(beyond, size),
           _share(blanks, size), _share(lines, size), _share(counts[:9].sum() + counts[14:32].sum() + counts[127], size)]
    out += [min(1.0, 20 * _share(counts[sign], size)) for sign in _SIGNS]

    gap = np.ones(size + 2, np.int8)
    gap[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(gap))
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    sums = running(data)
    words = spans_hash(sums, starts, ends) if n else np.empty(0, np.uint64)
    lengths = ends - starts
    last = data[ends - 1] if n else np.empty(0, np.uint8)
    first = data[starts] if n else np.empty(0, np.uint8)
    letter = lambda x: (x >= 128) | ((x | 32) >= 97) & ((x | 32) <= 122)
    odd = ~letter(last) & ~np.isin(last, np.frombuffer(b".,;:!?)\"'0123456789", np.uint8))
    distinct, most = _repetition(words)
    same = (words[1:] == words[:-1]).mean() if n > 1 else 0.0
    pairs = words[1:] * np.uint64(31) + words[:-1] if n > 1 else words
    large = ((first >= 65) & (first <= 90)).mean() if n else 0.0
    out += [np.log1p(n), lengths.mean() / 10 if n else 0.0, lengths.std() / 10 if n else 0.0, lengths.max() / 50 if n else 0.0, distinct,
            distinct * np.log1p(n), most, same, _repetition(pairs)[0], odd.mean() if n else 0.0, (~letter(first)).mean() if n else 0.0, large]

    breaks = np.concatenate([[-1], np.flatnonzero(data == 10), [size]])
    line_values = spans_hash(sums, breaks[:-1] + 1, breaks[1:])
    out += [np.log1p(len(line_values)), *_repetition(line_values), np.diff(breaks).max() / 2000]

    # The worst of several stretches: repetition, signs, capitals.
    worst = [1.0, 0.0, 0.0, 0.0, 0.0]
    caps = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    bounds = np.linspace(0, n, min(SEGMENTS, max(1, n // 12)) + 1).astype(int)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b > a:
            part = words[a:b]
            worst[0] = min(worst[0], _repetition(part)[0])
            worst[1] = max(worst[1], float((part[1:] == part[:-1]).mean()) if b - a > 1 else 0.0)
            worst[2] = max(worst[2], odd[a:b].mean())
            worst[3] = max(worst[3], _share(caps[ends[b - 1]] - caps[starts[a]], ends[b - 1] - starts[a]))
            worst[4] = max(worst[4], (lengths[a:b] == 1).mean())
    return np.nan_to_num(np.array(out + worst, np.float32))


class Network:
    """One hidden layer; ``score`` is the probability of a good text."""

    def __init__(self, width: int):
        source = np.random.default_rng(_SEED)
        self.mean, self.spread = np.zeros(width), np.ones(width)
        self.weights = [source.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), source.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def _forward(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(rows @ self.weights[0] + self.weights[1])
        return hidden, hidden @ self.weights[2] + self.weights[3]

    def _scaled(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.spread, -8, 8)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._forward(self._scaled(rows))[1], -30, 30)))

    def _gradient(self, rows: np.ndarray, hidden: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        back = slope[:, None] * self.weights[2] * (1 - hidden**2)
        return [rows.T @ back, back.sum(0), hidden.T @ slope, np.array([slope.sum()])]

    def train(self, good: np.ndarray, unlabelled: np.ndarray, prior: float) -> None:
        both = np.concatenate([good, unlabelled])
        self.mean, self.spread = both.mean(0), both.std(0) + 1e-3
        good, unlabelled = self._scaled(good), self._scaled(unlabelled)
        source = np.random.default_rng(_SEED)
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in self.weights]
        steps = 0
        for _ in range(EPOCHS):
            order_u, order_p = source.permutation(len(unlabelled)), source.permutation(len(good))
            batches = max(1, len(unlabelled) // _BATCH)
            for rows_u, rows_p in zip(np.array_split(order_u, batches), np.array_split(np.resize(order_p, max(len(order_p), batches)), batches)):
                p, u = good[rows_p], unlabelled[rows_u]
                (hidden_p, out_p), (hidden_u, out_u) = self._forward(p), self._forward(u)
                sig_p, sig_u = 1 / (1 + np.exp(-out_p)), 1 / (1 + np.exp(-out_u))
                # Logistic loss: good as good, good as not good, unlabelled as not good.
                as_bad = np.logaddexp(0, out_u).mean() - prior * np.logaddexp(0, out_p).mean()
                bad = [a - b for a, b in zip(self._gradient(u, hidden_u, sig_u / len(u)), self._gradient(p, hidden_p, prior * sig_p / len(p)))]
                if as_bad >= 0:
                    step = [a + b for a, b in zip(bad, self._gradient(p, hidden_p, prior * (sig_p - 1) / len(p)))]
                else:
                    step = [-a for a in bad]
                steps += 1
                for weight, gradient, (one, two) in zip(self.weights, step, moments):
                    gradient = gradient + 1e-4 * weight
                    one += 0.1 * (gradient - one)
                    two += 0.001 * (gradient**2 - two)
                    weight -= _RATE * (one / (1 - 0.9**steps)) / (np.sqrt(two / (1 - 0.999**steps)) + 1e-8)


def _discriminator(good: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression, its offset last, that tells good texts from unlabelled ones, both sides of equal weight."""
    rows = np.concatenate([good, unlabelled])
    rows = np.concatenate([rows, np.ones((len(rows), 1))], axis=1)
    wanted = np.concatenate([np.ones(len(good)), np.zeros(len(unlabelled))])
    share = np.concatenate([np.full(len(good), 0.5 / len(good)), np.full(len(unlabelled), 0.5 / len(unlabelled))])
    weights = np.zeros(rows.shape[1])
    for _ in range(_NEWTON):
        guess = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (share * (guess - wanted)) + _RIDGE * weights
        curve = (rows * (share * guess * (1 - guess))[:, None]).T @ rows + _RIDGE * np.eye(len(weights))
        weights -= np.linalg.solve(curve, slope)
    return weights


def estimated_prior(good: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of good texts among unlabelled ones, from features of both and no other labels.

    Any region holds at least the prior times as much of the unlabelled texts as of the good ones; a region without bad texts
    holds just that. Regions are what a discriminator scores above a threshold; it is fitted on one half of the texts and
    counted on the other, both ways. The least ratio counts, of regions with half of the good texts at least, so that both shares
    are known well.
    """
    both = np.concatenate([good, unlabelled])
    mean, spread = both.mean(0), both.std(0) + 1e-3
    sides = [np.clip((rows - mean) / spread, -8, 8) for rows in (good, unlabelled)]
    estimates = []
    for half in (0, 1):
        fitted, counted = ([rows[(half + k) % 2:: 2] for rows in sides] for k in (0, 1))
        if not all(map(len, (*fitted, *counted))):
            continue
        weights = _discriminator(*fitted)
        scores = [np.sort(rows @ weights[:-1]) for rows in counted]
        thresholds = np.quantile(scores[0], np.linspace(0, 0.5, 51))
        of_good, of_all = (1 - np.searchsorted(column, thresholds) / len(column) for column in scores)
        estimates.append(np.min(of_all / of_good))
    return float(np.clip(np.mean(estimates), 0.01, 0.99)) if estimates else 0.5


def held_out(id_column: Column) -> Column:
    """Whether the crc32 of the id as text leaves 1 when divided by 3; true for null ids, from which nothing is learned."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(True))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Network | None:
    """A network from the rows of ``docs`` and ``labels`` that aren't held out; None if no row is labelled good or none unlabelled.

    Several labels of one id count as good if any is. Null labels count as none.
    """
    known = slim(labels, id=id_col, label=label_col).filter("label is not null").groupBy("id").agg(F.max("label").alias("label")).filter(~held_out(F.col("id")))
    of_docs = slim(docs, id=id_col, text=text_col).filter(~held_out(F.col("id")))
    marked = of_docs.select("id").join(known, "id", "left")
    sizes = {row.label: row.n for row in marked.groupBy(
        F.when(F.col("label").isNull(), -1).otherwise((F.col("label") == 1).cast("int")).alias("label")).agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(-1):
        return None
    scale = 1 << 30
    limit = F.when(F.col("label") == 1, int(min(1.0, positives / sizes[1]) * scale)).when(
        F.col("label").isNull(), int(min(1.0, unlabelled / sizes[-1]) * scale)).otherwise(0)
    drawn = marked.filter(F.pmod(F.xxhash64("id"), F.lit(scale)) < limit).select("id", (F.col("label") == 1).alias("good")).distinct()

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "good": batch["good"], "row": [features(_bytes(text)) for text in batch["text"]]})

    sample = of_docs.join(checked_broadcast(drawn, "drawn"), "id").select("id", F.coalesce("good", F.lit(False)).alias("good"), "text")
    rows = sample.mapInPandas(describe, "id long, good boolean, row array<float>").toPandas().sort_values("id", kind="stable")  # bounded sample
    table, good = np.stack(rows["row"].to_numpy()).astype(float), rows["good"].to_numpy()
    if not good.any() or good.all():
        return None
    network = Network(table.shape[1])
    network.train(table[good], table[~good], estimated_prior(table[good], table[~good]))
    return network


def score(spark: SparkSession, network: Network | None, text: Column) -> Column:
    """The probability that a text is good, from 0 to 1; null texts count as empty; one half for all without a network."""
    if network is None:
        return F.lit(0.5)
    shared = spark.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        network = shared.value
        for batch in batches:
            yield pd.Series(network.score(np.stack([features(_bytes(text)) for text in batch]).astype(float)) if len(batch) else [], dtype=float)

    return run(text)


def with_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (replacing columns of these names)."""
    network = learn_quality(docs, labels, id_col, text_col, label_col)
    kept = [F.col(f"`{name}`") for name in docs.columns if name not in ("held_out", "score", "predicted")]
    scored = docs.select("*", score(docs.sparkSession, network, F.col(f"`{text_col}`")).alias("__score"))
    return scored.select(*kept, held_out(F.col(f"`{id_col}`")).alias("held_out"), F.col("__score").alias("score"),
                         (F.col("__score") >= 0.5).cast("int").alias("predicted"))
