"""JSON columns: test, extract, expand, change, render."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from lakeprofile.functions.lookup import as_column


def is_json(doc: Column | str) -> Column:
    """True for a valid JSON object or array (a bare scalar is not a document)."""
    doc = as_column(doc)
    container = F.coalesce(doc.rlike("^[ \\t\\r\\n]*[\\[{]"), F.lit(False))
    return container & F.try_parse_json(doc).isNotNull()


def _is_container(text: Column) -> Column:
    return text.rlike("^[\\[{]")


def json_value(doc: Column | str, path: str) -> Column:
    """Scalar at a path as text; null where the path is absent or holds an object or array."""
    value = F.try_variant_get(F.try_parse_json(as_column(doc)), path, "variant")
    kind = F.schema_of_variant(value)
    return F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"),
                  F.get_json_object(as_column(doc), path))


def json_query(doc: Column | str, path: str) -> Column:
    """Object or array at a path as JSON text; null for a scalar."""
    value = F.try_variant_get(F.try_parse_json(as_column(doc)), path, "variant")
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.get_json_object(as_column(doc), path))


def json_path_exists(doc: Column | str, path: str) -> Column:
    """True where the path exists, also when it holds JSON null."""
    return F.try_variant_get(F.try_parse_json(as_column(doc)), path, "variant").isNotNull()


def json_kind(value: Column) -> Column:
    """``scalar``, ``object`` or ``array`` of a variant."""
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("scalar")


def json_type_code(value: Column) -> Column:
    """Type code of a variant: null 0, string 1, number 2, boolean 3, array 4, object 5 (fixed values)."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", 0)
        .when(kind == "STRING", 1)
        .when(kind == "BOOLEAN", 3)
        .when(kind.startswith("ARRAY"), 4)
        .when(kind.startswith("OBJECT"), 5)
        .otherwise(2)
        .cast("bigint")
    )


def json_detected_type(value: Column) -> Column:
    """Detected type name of a variant (null counts as str)."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "BOOLEAN", "bool")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("OBJECT"), "dict")
        .when((kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$"), "int")
        .when((kind == "DOUBLE") | kind.startswith("DECIMAL") | (kind == "FLOAT"), "float")
        .otherwise("str")
    )


def json_text(value: Column) -> Column:
    """Variant as text: strings bare, objects and arrays as JSON, null as null."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json(value))
        .when(kind != "VOID", value.cast("string"))
    )


def with_json_entries(df: DataFrame, doc: str, key: str = "key", value: str = "value", type_code: str = "type",
                      path: str | None = None) -> DataFrame:
    """One row per member of the object or element of the array in ``doc`` (at ``path``), in place of ``doc``.

    Members come as key, value text and type code; elements are numbered from zero.
    """
    parsed = F.try_parse_json(F.col(doc))
    if path is not None:
        parsed = F.try_variant_get(parsed, path, "variant")
    others = [F.col(name) for name in df.columns if name != doc]
    entries = df.select(*others, parsed.alias("__parsed")).lateralJoin(
        df.sparkSession.tvf.variant_explode(F.col("__parsed").outer())
    )
    return entries.select(
        *others,
        F.coalesce(F.col("key"), F.col("pos").cast("string")).alias(key),
        json_text(F.col("value")).alias(value),
        json_type_code(F.col("value")).alias(type_code),
    )


def json_set(doc: Column | str, key: str, value: Column) -> Column:
    """Object text with one top-level key set; the other keys keep their order, a new key comes last.

    Null for text that is no JSON object, and for an object that repeats a key: which of its values counts is not defined.
    """
    doc = as_column(doc)
    members = F.from_json(F.when(F.try_parse_json(doc).isNotNull(), doc), "map<string,variant>")
    new = F.parse_json(F.to_json(F.struct(value.alias("v"))))
    replaced = F.transform_values(
        members, lambda k, v: F.when(k == key, F.variant_get(new, "$.v", "variant")).otherwise(v)
    )
    added = F.map_concat(members, F.create_map(F.lit(key), F.variant_get(new, "$.v", "variant")))
    return F.when(members.isNotNull(),
                  F.to_json(F.when(F.map_contains_key(members, key), replaced).otherwise(added)))


def json_object(*columns: str, include_nulls: bool = True) -> Column:
    """Row as a JSON object of the named columns."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false" if include_nulls else "true"})


def finite_or_null(number: Column | str) -> Column:
    """NaN and infinities have no JSON form: null."""
    number = as_column(number)
    infinite = number.isin(float("inf"), float("-inf"))
    return F.when(~F.isnan(number) & ~infinite, number)


def json_brackets(root: str | None) -> tuple[str, str]:
    """What opens and closes an array of rows, inside an object with one key if ``root`` is given."""
    return ("[", "]") if root is None else ("{" + json.dumps(root, ensure_ascii=False) + ":[", "]}")


def json_rows(df: DataFrame, order_by: str, root: str | None = None, include_nulls: bool = False) -> DataFrame:
    """A table as one JSON array, in pieces: concatenating ``fragment`` in the order of the key gives the document.

    The key must identify rows. Nothing is gathered: every row renders its own piece, and the two ends are found
    with one min/max aggregate, so the document may be larger than any machine.
    """
    ends = df.agg(F.min(order_by).alias("first_key"), F.max(order_by).alias("last_key"))
    key = F.col(order_by)
    opening, closing = json_brackets(root)
    body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false" if include_nulls else "true"})
    return df.select(
        key,
        F.concat(
            F.when(key == ends.select("first_key").scalar(), F.lit(opening)).otherwise(F.lit(",")),
            body,
            F.when(key == ends.select("last_key").scalar(), F.lit(closing)).otherwise(F.lit("")),
        ).alias("fragment"),
    )
