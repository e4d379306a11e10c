"""Removal of repeated runs of lines.

Every three consecutive lines of a text form a window. A window found more than once anywhere in the table is kept where it
occurs first (smallest id, then smallest line number); each later occurrence marks its three lines, overlapping marks merge,
and marked lines go.

Only DataFrame functions are used. Windows are counted with a partial aggregate before the shuffle, so a window that a third
of all documents share arrives as one row per task; the join that finds the later occurrences is an equi-join that Spark may
split where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakeprofile.llm.common import slim

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Later occurrences of repeated windows: ``id`` and ``at``, the number of the window's first line, from 0.

    Windows whose lines are all blank don't count. Texts with fewer lines than a window have none.
    """
    lines = F.col("lines")
    parts = slim(docs, id=id_col, text=text_col).select("id", _lines(F.col("text")).alias("lines"))
    parts = parts.filter(F.size(lines) >= window)

    def joined(first: Column, at: Column) -> Column:
        rest = [F.get(lines, at + F.lit(step)) for step in range(1, window)]
        text = F.concat_ws("\n", first, *rest)
        return F.when(F.length(F.trim(F.translate(text, "\n\r\t", ""))) > 0, F.unhex(F.md5(text)))

    windows = (
        parts.select("id", F.posexplode(F.transform(F.slice(lines, 1, F.size(lines) - (window - 1)), joined)).alias("at", "window"))
        .filter(F.col("window").isNotNull())
    )
    first = (
        windows.groupBy("window").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("times"))
        .filter("times > 1").select("window", F.col("first.id").alias("first_id"), F.col("first.at").alias("first_at"))
    )
    later = ~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("at") == F.col("first_at")))
    return windows.join(first, "window").filter(later).select("id", "at")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the later occurrences of repeated windows cut from its text.

    All columns stay, ``text_col`` holds the remaining lines (an empty text if none remain), and two columns follow:
    ``n_lines`` and ``n_removed``, longs, replacing input columns of these names. A null text stays null and has no lines; an
    empty text is one empty line. Rows that repeat an id are one document with respect to what is marked: a line marked in one
    of them goes in all. Null ids are taken as one id, the smallest. An empty table gives an empty table.
    """
    marked = (
        repeated_windows(docs, id_col, text_col, window).groupBy(F.col("id").alias("__marked_id"))
        .agg(F.collect_set("at").alias("__marked_at"))
    )
    lines = _lines(F.col(f"`{text_col}`"))
    covered = F.array_distinct(F.flatten(F.transform("__marked_at", lambda at: F.sequence(at, at + F.lit(window - 1)))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    kept_text = F.array_join(F.transform(left, lambda at: F.get(lines, at)), "\n")
    hit = F.col("__marked_at").isNotNull()
    n_lines = F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_removed = F.when(hit, F.size(lines) - F.size(left)).otherwise(0).cast("long")
    columns = [
        F.when(hit & F.col(f"`{text_col}`").isNotNull(), kept_text).otherwise(F.col(f"`{text_col}`")).alias(name)
        if name == text_col else F.col(f"`{name}`")
        for name in docs.columns if name not in ("n_lines", "n_removed")
    ]
    return docs.join(marked, F.col(f"`{id_col}`").eqNullSafe(F.col("__marked_id")), "left").select(
        *columns, n_lines.alias("n_lines"), F.coalesce(n_removed, F.lit(0)).alias("n_removed"))
