"""Identifiers, literals and display text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lakeprofile.functions.lookup import as_column, look_up
from lakeprofile.functions.paths import name_stem
from lakeprofile.functions.urls import location_name
from lakeprofile.lookups import DELIMITER_NAMES

# Characters that may not appear in one-line text (fixed values).
CONTROL_RUN = "[\\x00-\\x1f\\x7f\\u2028\\u2029]+"
# White space trimmed from the ends of one-line text.
EDGE_SPACE = "^[\\s\\x{85}\\p{Z}]+|[\\s\\x{85}\\p{Z}]+$"


def clean_identifier(name: Column | str) -> Column:
    """ASCII letters, digits and underscores only; never empty, never led by a digit."""
    clean = F.regexp_replace(as_column(name), "[^A-Za-z0-9_]", "_")
    return (
        F.when(clean == "", "column_1")
        .when(clean.rlike("^[0-9]"), F.concat(F.lit("col_"), clean))
        .otherwise(clean)
    )


def table_name(path: Column | str) -> Column:
    """External table name for a path: its stem, letters and digits of any script kept."""
    clean = F.regexp_replace(name_stem(location_name(path)), "[^\\p{L}\\p{N}]", "_")
    clean = (
        F.when(clean == "", "external_table")
        .when(clean.rlike("^\\p{Nd}"), F.concat(F.lit("tbl_"), clean))
        .otherwise(clean)
    )
    return F.concat(F.lit("ext_"), clean)


def escape_bracketed(name: Column | str) -> Column:
    """Text safe inside ``[...]``."""
    return F.replace(as_column(name), F.lit("]"), F.lit("]]"))


def escape_literal(value: Column | str) -> Column:
    """Text safe inside ``'...'``."""
    return F.replace(as_column(value), F.lit("'"), F.lit("''"))


def one_line(text: Column | str) -> Column:
    """Runs of control characters and line separators become one space; ends are trimmed."""
    return F.regexp_replace(F.regexp_replace(as_column(text), CONTROL_RUN, " "), EDGE_SPACE, "")


def shown_delimiter(delimiter: Column | str) -> Column:
    """Delimiter with control characters spelled out."""
    text = as_column(delimiter)
    for character, spelled in (("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        text = F.replace(text, F.lit(character), F.lit(spelled))
    return text


def delimiter_name(delimiter: Column | str) -> Column:
    """English name of a delimiter, or the delimiter itself in quotes."""
    quoted = F.concat(F.lit("'"), shown_delimiter(delimiter), F.lit("'"))
    return F.coalesce(look_up(delimiter, DELIMITER_NAMES), quoted)


def json_path(key: Column | str) -> Column:
    """``$.key``, or ``$."odd key"`` where the key needs quotes; safe inside ``'...'``."""
    key = as_column(key)
    quoted = F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    path = F.when(key.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("$."), key)).otherwise(
        F.concat(F.lit('$."'), quoted, F.lit('"'))
    )
    return escape_literal(path)


def safe_sql_type(sql_type: Column | str, fallback: str = "NVARCHAR(MAX)") -> Column:
    """A type name with optional length and scale; anything else becomes ``fallback``."""
    candidate = F.btrim(as_column(sql_type))
    shape = r"(?i)^[A-Za-z][A-Za-z0-9_]*\s*(\(\s*(\d+|MAX)\s*(,\s*\d+\s*)?\))?$"
    return F.when(candidate.rlike(shape), candidate).otherwise(F.lit(fallback))


def readable_size(size: Column | str) -> Column:
    """Bytes as ``0 B``, ``12.5 KB``, ...; one decimal, exact halves to even, GB at most."""
    size = as_column(size).cast("double")

    def scaled(divisor: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", F.bround(size / F.lit(divisor), 1))

    return (
        F.when(size == 0, "0 B")
        .when(size < 1024, scaled(1, "B"))
        .when(size < 1024**2, scaled(1024, "KB"))
        .when(size < 1024**3, scaled(1024**2, "MB"))
        .otherwise(scaled(1024**3, "GB"))
    )


def rendered_row(values: Column, names: Column, width: int = 20, shown: int = 8) -> Column:
    """Struct ``header, line``: the first columns of a sample row, each cut to ``width`` characters."""
    more = F.size(names) - shown
    cell = lambda value: F.substring(one_line(F.coalesce(value, F.lit("NULL"))), 1, width)
    header = F.array_join(F.transform(F.slice(names, 1, shown), cell), " | ")
    line = F.array_join(F.transform(F.slice(values, 1, shown), cell), " | ")
    return F.struct(
        F.when(more > 0, F.concat(header, F.format_string(" | ... (%d more)", more))).otherwise(header).alias("header"),
        F.when(more > 0, F.concat(line, F.lit(" | ..."))).otherwise(line).alias("line"),
    )


def sample_lines(rows: Column, names: Column) -> Column:
    """Sample rows as lines of text under a header line."""
    header = rendered_row(F.get(rows, F.lit(0)), names)["header"]
    lines = F.transform(rows, lambda row: rendered_row(row, names)["line"])
    return F.when(F.size(rows) > 0, F.concat(F.array(header), lines))


def member_lines(columns: Column, width: int = 60, shown: int = 10) -> Column:
    """First members of a sampled document as ``name: value`` lines, values cut to ``width`` characters."""
    return F.transform(
        F.slice(columns, 1, shown),
        lambda column: F.concat(
            one_line(column["name"]), F.lit(": "),
            F.substring(one_line(F.coalesce(column["sample_value"], F.lit("NULL"))), 1, width),
        ),
    )


def text_prefix(text: Column | str, limit: int = 5000) -> Column:
    """Preview of a text: its first characters and a marker where more follow."""
    text = as_column(text)
    marked = F.concat(F.substring(text, 1, limit), F.lit("\n... (truncated)"))
    return F.when(F.length(text) > limit, marked).otherwise(text)
