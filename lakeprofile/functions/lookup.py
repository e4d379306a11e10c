"""Small fixed tables as map expressions: no join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def look_up(key: Column | str, table: dict) -> Column:
    """Value for ``key`` in a fixed table, null where it has none."""
    items = ", ".join(f"{sql_text(name)}, {sql_text(value)}" for name, value in table.items())
    # Written as SQL, a table is one expression to build however many entries it has.
    return F.try_element_at(F.expr(f"map({items})"), as_column(key))


def first_contained(text: Column, words: list[str]) -> Column:
    """First word of a fixed list that occurs in ``text``, null if none does."""
    listed = F.expr(f"array({', '.join(sql_text(word) for word in words)})")
    return F.get(F.filter(listed, lambda word: text.contains(word)), F.lit(0))
