"""Keys and field types over whole columns of JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakeprofile.functions.jsonfn import json_detected_type

# Detected types by number. Aggregating small numbers keeps the hash aggregation; text or structs would sort the data.
TYPE_NAMES = ["bool", "int", "float", "str", "list", "dict"]


def json_keys(df: DataFrame, doc: str, order_by: str) -> DataFrame:
    """Every key of the objects in ``doc`` and where it was first seen (``key, first_row, first_pos``)."""
    keys = df.select(order_by, F.posexplode(F.json_object_keys(doc)).alias("pos", "key"))
    return keys.groupBy("key").agg(
        F.min(order_by).alias("first_row"), F.min_by("pos", order_by).cast("bigint").alias("first_pos")
    )


def json_fields(df: DataFrame, doc: str, order_by: str) -> DataFrame:
    """Kind and detected type per key, from its first value that is not null. Documents never travel."""
    members = df.select(order_by, F.explode(F.from_json(doc, "map<string,variant>")).alias("key", "value"))
    names = F.array(*[F.lit(name) for name in TYPE_NAMES])
    coded = members.filter(~F.is_variant_null("value")).select(
        order_by, "key", F.array_position(names, json_detected_type(F.col("value"))).cast("int").alias("code")
    )
    first = coded.groupBy("key").agg(F.min_by("code", order_by).alias("code"))
    detected = F.element_at(names, F.col("code"))
    kind = F.when(detected == "list", "array").when(detected == "dict", "object").otherwise("scalar")
    return first.select("key", kind.alias("kind"), detected.alias("detected_type"))
