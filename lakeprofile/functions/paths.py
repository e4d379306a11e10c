"""File names and folders out of path columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lakeprofile.functions.lookup import as_column, look_up
from lakeprofile.lookups import EXTENSION_TYPES


def base_name(path: Column | str) -> Column:
    """Text after the last slash."""
    return F.regexp_extract(as_column(path), "([^/]*)$", 1)


def parent_path(path: Column | str) -> Column:
    """Text before the last slash."""
    return F.regexp_extract(as_column(path), "^(.*)/[^/]*$", 1)


def name_stem(name: Column | str) -> Column:
    """File name without its last extension; leading dots belong to the stem."""
    name = as_column(name)
    stem = F.regexp_extract(name, r"^(\.*[^.].*)\.[^.]*$", 1)
    return F.when(stem != "", stem).otherwise(name)


def path_suffix(name: Column | str) -> Column:
    """Lower-case last extension with its dot, or empty."""
    return F.lower(F.regexp_extract(as_column(name), r"^.+(\.[^.]+)$", 1))


def type_by_extension(name: Column | str) -> Column:
    """File type for a file name, null where the extension says nothing."""
    return look_up(path_suffix(name), EXTENSION_TYPES)


def ancestors(path: Column | str) -> Column:
    """Every folder above a path, from the top down."""
    parts = F.split(as_column(path), "/")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda length: F.array_join(F.slice(parts, 1, length), "/"),
    )
