"""Text encodings from raw bytes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lakeprofile.functions.lookup import as_column, look_up
from lakeprofile.lookups import CODEPAGES, DEFAULT_CODEPAGE

# Byte-order mark in hex -> encoding, longest first (fixed values).
BYTE_ORDER_MARKS = [
    ("EFBBBF", "utf-8-sig"),
    ("FFFE0000", "utf-32"),
    ("0000FEFF", "utf-32"),
    ("FFFE", "utf-16"),
    ("FEFF", "utf-16"),
]
# Bytes that code page 1252 leaves undefined (fixed values).
UNDEFINED_IN_1252 = "81 8D 8F 90 9D"


def _complete_utf8(content: Column) -> Column:
    """Content less an incomplete last character, which a cut-off prefix may end in."""
    size = F.octet_length(content)
    tail = F.hex(content.substr(F.greatest(size - 2, F.lit(1)), F.lit(3)))
    # Lead bytes of 2-, 3- and 4-byte characters with continuation bytes missing.
    cut = (
        F.when(tail.rlike("(?:F[0-7][89AB][0-9A-F][89AB][0-9A-F])$"), 3)
        .when(tail.rlike("(?:[EF][0-9A-F][89AB][0-9A-F])$"), 2)
        .when(tail.rlike("(?:[C-F][0-9A-F])$") & tail.rlike("^(?:[0-9A-F]{2})+$"), 1)
        .otherwise(0)
    )
    return content.substr(F.lit(1), size - cut)


def encoding_of(head: Column, high: Column, utf8: Column, undefined: Column) -> Column:
    """Struct ``encoding, confidence`` of bytes: ``head`` are the first four in hex.

    Byte-order mark, then pure ASCII (no ``high`` bytes), then valid UTF-8, then code page 1252 (no bytes it leaves
    ``undefined``), then Latin-1.
    """
    def verdict(name: str, confidence: float) -> Column:
        return F.struct(F.lit(name).alias("encoding"), F.lit(confidence).alias("confidence"))

    result = None
    for mark, name in BYTE_ORDER_MARKS:
        condition = head.startswith(mark)
        result = F.when(condition, verdict(name, 1.0)) if result is None else result.when(condition, verdict(name, 1.0))
    return (
        result.when(~high, verdict("ascii", 1.0))
        .when(utf8, verdict("utf-8", 0.99))
        .when(~undefined, verdict("cp1252", 0.5))
        .otherwise(verdict("latin-1", 0.4))
    )


def detect_encoding(content: Column | str, complete: Column | None = None) -> Column:
    """``encoding_of`` raw bytes; ``complete`` is false where they are a prefix.

    What a prefix tells of a longer file holds for the prefix only: see ``sources.encoding.whole_encodings``.
    """
    content = as_column(content)
    # ISO-8859-1 maps every byte to the character of the same number, so patterns can look at bytes.
    characters = F.decode(content, "ISO-8859-1")
    whole = content if complete is None else F.when(complete, content).otherwise(_complete_utf8(content))
    undefined = "[" + "".join(f"\\x{code}" for code in UNDEFINED_IN_1252.split()) + "]"
    return encoding_of(F.hex(content.substr(F.lit(1), F.lit(4))), characters.rlike("[\\x80-\\xff]"), F.is_valid_utf8(whole),
                       characters.rlike(undefined))


def codepage(encoding: Column | str) -> Column:
    """Code page of an encoding name, ``ACP`` where unknown."""
    return F.coalesce(look_up(F.lower(F.btrim(as_column(encoding))), CODEPAGES), F.lit(DEFAULT_CODEPAGE))


def encoding_warning(encoding: Column | str, confidence: Column | str) -> Column:
    """Note for a confidence below one half, else null."""
    percent = F.round(as_column(confidence) * 100).cast("bigint")
    note = F.format_string(
        'Low confidence (%d%%) for encoding "%s". Verify encoding manually or specify it explicitly.',
        percent, as_column(encoding),
    )
    return F.when(as_column(confidence) < 0.5, note)
