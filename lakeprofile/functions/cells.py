"""What a text cell holds: the classes behind type inference, shared by samples and full scans."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Classes in the order they widen: every integer is a number; booleans and text stand apart.
INTEGER, NUMBER, BOOLEAN, TEXT = range(4)


def null_if_blank(cell: Column, null_words: list[str] | None = None) -> Column:
    """Empty text is missing; so are the caller's own null words."""
    words = ["", *(null_words or [])]
    return F.when(~cell.isin(*words), cell)


DIGITS = "^\\s*[+-]?[0-9]+\\s*$"
# A number that is no plain integer: a fraction, an exponent, or a value that is not finite.
FRACTION = (
    "^\\s*[+-]?([0-9]+\\.?[0-9]*([eE][+-]?[0-9]+)?|\\.[0-9]+([eE][+-]?[0-9]+)?"
    "|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\\s*$"
)


def cell_class(cell: Column) -> Column:
    """Class of one cell, null for a missing one."""
    # Patterns first: a cast that fails throws inside, which costs far more. Up to 18 digits always fit.
    whole = cell.rlike(DIGITS)
    fits = (F.length(cell) <= 18) | cell.try_cast("bigint").isNotNull()
    return (
        F.when(cell.isNull(), None)
        .when(whole & fits, INTEGER)
        .when(cell.rlike(FRACTION), NUMBER)
        .when(F.lower(cell).isin("true", "false"), BOOLEAN)
        .otherwise(TEXT)
    )


def column_type(lowest: Column, highest: Column, any_null: Column) -> Column:
    """Detected type from the range of a column's classes (null where it has no value).

    Missing values widen integers to float64 and booleans to object.
    """
    return (
        F.when(highest.isNull(), "float64")
        .when((highest == INTEGER) & ~any_null, "int64")
        .when(highest <= NUMBER, "float64")
        .when((lowest == BOOLEAN) & (highest == BOOLEAN) & ~any_null, "bool")
        .otherwise("object")
    )
