"""Detected types to SQL and Spark types; string sizing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lakeprofile.functions.lookup import as_column, first_contained, look_up
from lakeprofile.lookups import DEFAULT_DECIMAL, DEFAULT_STRING, LONG_STRING, TYPES


def sized_length(observed: Column | str) -> Column:
    """Observed maximum length plus a quarter, rounded up."""
    observed = as_column(observed).cast("bigint")
    return F.when(observed <= 0, F.lit(0)).otherwise(F.ceil(observed * 1.25)).cast("bigint")


def string_type(length: Column | str) -> Column:
    """SQL string type for a sized length; the default where the length is unknown or small."""
    length = as_column(length).cast("bigint")
    rounded = F.least((F.floor(length / 50) + 1) * 50, F.lit(4000)).cast("bigint")
    return (
        F.when(length > 4000, LONG_STRING)
        .when(length > 200, F.format_string("NVARCHAR(%d)", rounded))
        .otherwise(DEFAULT_STRING)
    )


def _mapped(detected: Column, position: int) -> Column:
    """Entry for a type name, else for the first known name it contains."""
    known = {row[0]: row[position] for row in TYPES}
    return F.coalesce(look_up(detected, known), look_up(first_contained(detected, list(known)), known))


def sql_type(detected: Column | str, length: Column | str | None = None) -> Column:
    """SQL type of a detected type: by name, else by the first known name it contains."""
    detected = F.lower(as_column(detected))
    exact = look_up(detected, {row[0]: row[1] for row in TYPES})
    decimal = F.when(detected.contains("decimal") | detected.contains("numeric"), DEFAULT_DECIMAL)
    mapped = F.coalesce(_mapped(detected, 1), decimal, F.lit(DEFAULT_STRING))
    if length is None:
        return mapped
    # Only a type known by name takes its size from the data.
    return F.when((exact == DEFAULT_STRING) & as_column(length).isNotNull(), string_type(length)).otherwise(mapped)


def spark_type(detected: Column | str) -> Column:
    """Spark type of a detected type; a decimal keeps its own precision and scale."""
    detected = F.lower(as_column(detected))
    precise = F.regexp_extract(detected, r"^decimal(?:128)?\((\d+,\s*\d+)\)$", 1)
    return F.when(precise != "", F.concat(F.lit("decimal("), precise, F.lit(")"))).otherwise(
        F.coalesce(_mapped(detected, 2), F.lit("string"))
    )
