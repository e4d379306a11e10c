"""Predicts the language of texts: known words by their log frequency per language, other words by character n-grams.

The model is learned from a bounded sample of labelled rows (``PER_LANGUAGE`` texts a language, drawn by a hash of the id) and
holds at most ``WORDS_PER_LANGUAGE`` words of each. A word that no language knows falls back, position by position, to the
longest known n-gram that starts there, from ``LONGEST`` characters down to one. Scores are summed over all words of the whole
text; the posterior over the languages is the score.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lakeprofile.llm.common import slim

PER_LANGUAGE = 4000
WORDS_PER_LANGUAGE = 20_000
LONGEST = 4
SMOOTHING = 0.5
UNDETERMINED = "und"
_MEMO = 100_000
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


class LogTable:
    """Smoothed log frequencies per language of words or n-grams: numbers of rows by key, and the rows."""

    def __init__(self, counts: dict[str, Counter], languages: list[str]):
        keys = sorted({key for language in languages for key in counts[language]})
        self.at = {key: nth for nth, key in enumerate(keys)}
        table = np.array([[counts[language][key] for language in languages] for key in keys], float).reshape(len(keys), len(languages))
        totals = table.sum(axis=0) + SMOOTHING * (len(keys) + 1)
        self.rows = np.log((table + SMOOTHING) / totals).astype(np.float32)

    def get(self, key: str) -> np.ndarray | None:
        nth = self.at.get(key)
        return None if nth is None else self.rows[nth]


@dataclass
class LanguageModel:
    languages: list[str]
    words: LogTable
    grams: list[LogTable]  # of one character, two, ...; all have the rows ``gram_rows``
    gram_rows: np.ndarray  # the last one, of zeros, stands for what no language knows

    def longest(self, rest: str) -> int:
        """The row of the longest known n-gram that ``rest`` starts with."""
        for length in range(min(len(self.grams), len(rest)), 0, -1):
            row = self.grams[length - 1].at.get(rest[:length])
            if row is not None:
                return row
        return len(self.gram_rows) - 1

    def unseen(self, word: str, longest: Callable[[str], int] | None = None) -> np.ndarray:
        """The score of a word that no language knows."""
        marked, longest = f"<{word}>", longest or self.longest
        return self.gram_rows[[longest(marked[at: at + LONGEST]) for at in range(len(marked))]].sum(axis=0, dtype=float)


def model_of(words: dict[str, Counter]) -> LanguageModel:
    """The model of words counted per language."""
    languages, grams = sorted(words), []
    for length in range(1, LONGEST + 1):
        counts: dict[str, Counter] = {language: Counter() for language in languages}
        for language in languages:
            for word, n in words[language].items():
                marked = f"<{word}>"
                for at in range(len(marked) - length + 1):
                    counts[language][marked[at: at + length]] += n
        grams.append(LogTable(counts, languages))
    rows = np.concatenate([*(table.rows for table in grams), np.zeros((1, len(languages)), np.float32)])
    before = 0
    for table in grams:
        table.at, before = {gram: before + nth for gram, nth in table.at.items()}, before + len(table.rows)
        table.rows = rows
    return LanguageModel(languages, LogTable(words, languages), grams, rows)


def held_out(id_column: Column, folds: int) -> Column:
    """Whether the crc32 of the id as text leaves no remainder; true for null ids, from which nothing is learned."""
    return F.coalesce(F.crc32(id_column.cast("string")) % folds == 0, F.lit(True))


def learn_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                    per_language: int = PER_LANGUAGE, words_per_language: int = WORDS_PER_LANGUAGE) -> LanguageModel:
    """A model from the rows of ``docs`` with a language and a text.

    Every language is learned that a row names, but for ``und``, which is no language; what the driver collects, and the model,
    grow with the number of languages and not with the rows. Rows that repeat an id are drawn or left out together and count
    each. Without such rows, as with an empty table, the model knows no language.
    """
    rows = slim(docs, id=id_col, text=text_col, lang=lang_col).filter("lang is not null and text is not null and lang <> 'und'")
    sizes = {row.lang: row.n for row in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return model_of({})
    scale = 1 << 30
    share = F.create_map([F.lit(x) for lang in languages for x in (lang, int(min(1.0, per_language / sizes[lang]) * scale))])
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(scale)) < F.coalesce(share[F.col("lang")], F.lit(0)))

    def count_words(batches: Iterator) -> Iterator:
        for batch in batches:
            counts: dict = defaultdict(Counter)
            for text, lang in zip(batch.text, batch.lang):
                counts[lang].update(_WORD.findall(text.lower()))
            rows = [(lang, word, n) for lang, found in counts.items() for word, n in found.items()]
            yield pd.DataFrame(rows, columns=["lang", "word", "n"])

    counted = sample.select("text", "lang").mapInPandas(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n"))
    top = counted.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(
        f"nth <= {words_per_language}")
    words: dict[str, Counter] = {lang: Counter() for lang in languages}
    for row in top.select("lang", "word", "n").toLocalIterator():  # bounded: words_per_language for each language
        words[row.lang][row.word] = row.n
    return model_of(words)


class _Longest(dict):
    """The next ``LONGEST`` characters, or the last ones, of a marked word to the row of the longest known n-gram they start with."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model

    def __missing__(self, rest: str) -> int:
        if len(self) > _MEMO:
            self.clear()
        self[rest] = row = self.model.longest(rest)
        return row


class _Scores(dict):
    """Word to the number of its row in ``rows``."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model, self.rows = model, np.zeros((1024, len(model.languages)), np.float32)
        self.longest = _Longest(model)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        known = self.model.words.get(word)
        self.rows[at] = self.model.unseen(word, self.longest.__getitem__) if known is None else known
        self[word] = at
        return at


def identify(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """A struct of ``lang_pred`` and ``score`` for a text column.

    ``und`` with score 0 stands for null texts, texts without a letter, and for every text if the model knows no language.
    Equal scores go to the language that sorts first.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        scores = _Scores(model)
        for batch in batches:
            languages, posteriors = [], []
            for text in batch:
                found = _WORD.findall(text.lower()) if text else None
                if not found or not model.languages:
                    languages.append(UNDETERMINED)
                    posteriors.append(0.0)
                    continue
                if len(scores) > _MEMO:
                    scores = _Scores(model)
                at = list(map(scores.__getitem__, found))
                total = scores.rows[at].sum(axis=0, dtype=float)
                total = np.exp(total - total.max())
                best = int(total.argmax())
                languages.append(model.languages[best])
                posteriors.append(float(total[best] / total.sum()))
            yield pd.DataFrame({"lang_pred": languages, "score": posteriors})

    return predict(text)


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score`` (replacing columns of these names), learned from its rows that aren't held out."""
    model = learn_languages(docs.filter(~held_out(F.col(f"`{id_col}`"), folds)), text_col, lang_col, id_col)
    kept = [F.col(f"`{name}`") for name in docs.columns if name not in ("held_out", "lang_pred", "score")]
    guess = identify(docs.sparkSession, model, F.col(f"`{text_col}`")).alias("__guess")
    return docs.select("*", guess).select(
        *kept, held_out(F.col(f"`{id_col}`"), folds).alias("held_out"), F.col("__guess.lang_pred").alias("lang_pred"), F.col("__guess.score").alias("score"))


def drop_undetermined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose text is null, has no letter, or fits no language better than the others (score below one half)."""
    model = learn_languages(docs.filter(~held_out(F.col(f"`{id_col}`"), 5)), text_col, lang_col, id_col)
    judged = docs.select("*", identify(docs.sparkSession, model, F.col(f"`{text_col}`")).alias("__guess"))
    return judged.filter("__guess.lang_pred <> 'und' and __guess.score >= 0.5").select(*[F.col(f"`{name}`") for name in docs.columns])
