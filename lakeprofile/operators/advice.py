"""Load methods, recommended paths and warnings per profiled file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakeprofile.lookups import (
    ADVICE_COLUMNAR, ADVICE_CONVERT, ADVICE_DEFAULT, ADVICE_FABRIC, ADVICE_JSON, ADVICE_TEXT, BULK_INSERT_PLATFORMS,
    EXTERNAL_FORMAT_PLATFORMS, EXTERNAL_FORMATS, EXTERNAL_TABLE_PLATFORMS, FILE_TYPES, LOAD_METHODS,
    OPENROWSET_PLATFORMS, PLATFORMS, STAGING_DEFAULT, STAGING_LARGE, STAGING_SMALL,
)


def _available(method: str, file_type: str, platform: str) -> bool:
    if method == "bulk_insert":
        return file_type in ("csv", "text") and platform in BULK_INSERT_PLATFORMS
    if method == "openrowset":
        return platform in OPENROWSET_PLATFORMS.get(file_type, PLATFORMS)
    if method == "external_table":
        external = EXTERNAL_FORMATS.get(file_type, "DELIMITEDTEXT")
        return platform in EXTERNAL_TABLE_PLATFORMS and platform in EXTERNAL_FORMAT_PLATFORMS[external]
    return file_type == "json" if method == "openjson" else True


def capabilities(spark: SparkSession) -> DataFrame:
    """Every file type, platform and method, with rank and availability: a few hundred fixed rows."""
    rows = [
        (file_type, platform, method, rank, _available(method, file_type, platform))
        for file_type in FILE_TYPES
        for platform in PLATFORMS
        for method, (rank, _) in LOAD_METHODS.items()
    ]
    return spark.createDataFrame(
        rows, "file_type string, platform string, method string, preference int, available boolean"
    )


def methods_by_type(spark: SparkSession, platform: str | None = None) -> DataFrame:
    """Usable methods in order of preference, one row per file type and platform."""
    usable = capabilities(spark).filter("available")
    if platform is not None:
        usable = usable.filter(F.col("platform") == platform)
    ranked = F.sort_array(F.collect_list(F.struct("preference", "method")))
    return usable.groupBy("file_type", "platform").agg(
        F.transform(ranked, lambda choice: choice["method"]).alias("load_methods")
    )


def with_load_methods(profiles: DataFrame, platform: str) -> DataFrame:
    """Profiles plus the array ``load_methods``; the fixed capability table is broadcast."""
    methods = methods_by_type(profiles.sparkSession, platform).select("file_type", "load_methods")
    return profiles.join(F.broadcast(methods), "file_type", "left")


def load_methods(profiles: DataFrame, platform: str | None = None) -> DataFrame:
    """Usable methods per file and platform, ranked (``path, platform, position, method``)."""
    methods = F.broadcast(methods_by_type(profiles.sparkSession, platform))
    return profiles.select("path", "file_type").join(methods, "file_type").select(
        "path", "file_type", "platform", F.posexplode("load_methods").alias("position", "method")
    ).withColumn("position", F.col("position") + 1)


def unavailable_methods(profiles: DataFrame, platform: str) -> DataFrame:
    """Methods a platform lacks for a file, with the first usable one as the alternative."""
    table = capabilities(profiles.sparkSession).filter(F.col("platform") == platform)
    best = table.filter("available").groupBy("file_type").agg(F.min_by("method", "preference").alias("alternative"))
    missing = table.filter("NOT available").join(best, "file_type")
    return profiles.select("path", "file_type").join(F.broadcast(missing), "file_type").select(
        "path", "file_type", "platform", "method", "alternative"
    )


def load_advice(file_type: Column, size: Column, platform: str) -> Column:
    """Struct ``best, fastest, cheapest, staging`` for a file of a type and size."""
    best, fastest, cheapest = (F.lit(text) for text in ADVICE_DEFAULT)
    if platform == "fabric_sql_db":
        best, fastest, cheapest = (F.lit(text) for text in ADVICE_FABRIC)
    else:
        text, columnar = file_type.isin("csv", "text"), file_type.isin("parquet", "delta")
        if platform == "sql_server_2019":
            columnar_best = F.format_string(ADVICE_CONVERT[0], F.initcap(file_type))
            columnar_fastest = ADVICE_CONVERT[1]
        else:
            columnar_best = F.format_string(ADVICE_COLUMNAR[0], F.upper(file_type))
            columnar_fastest = ADVICE_COLUMNAR[1]
        best = (F.when(text, ADVICE_TEXT[0]).when(file_type == "json", ADVICE_JSON[0]).when(columnar, columnar_best)
                .otherwise(best))
        fastest = (F.when(text, ADVICE_TEXT[1]).when(file_type == "json", ADVICE_JSON[1])
                   .when(columnar, columnar_fastest).otherwise(fastest))
    megabytes = F.coalesce(size, F.lit(0)) / (1024 * 1024)
    staging = (
        F.when(megabytes > 512, STAGING_LARGE).when(megabytes < 25, STAGING_SMALL).otherwise(STAGING_DEFAULT)
    )
    return F.struct(best.alias("best"), fastest.alias("fastest"), cheapest.alias("cheapest"),
                    staging.alias("staging"))


# Parts of a type name that mark a number (fixed values).
NUMERIC_MARKERS = "int|float|double|decimal|numeric|real"


def warnings_of(profiles: DataFrame) -> Column:
    """Array of warnings about a profiled file, from its own row."""
    columns = F.coalesce("columns", F.array().cast(profiles.schema["columns"].dataType))
    low = (F.col("encoding") != "binary") & (F.col("encoding_confidence") < 70)
    nested = (F.col("file_type") == "json") & F.exists(
        columns, lambda c: F.coalesce(c["nesting"].isin("object", "array"), F.lit(False)))
    long = F.exists(columns, lambda c: F.coalesce(c["sized_len"] > 4000, F.lit(False)))
    numeric = F.transform(
        F.filter(columns, lambda c: c["nullable"] & F.lower(c["detected_type"]).rlike(NUMERIC_MARKERS)),
        lambda c: c["name"],
    )
    return F.array_compact(F.array(
        F.when(low, F.format_string("Low encoding confidence (%d%%). Verify file encoding before loading.",
                                    "encoding_confidence")),
        F.when(F.col("row_count_estimated"), "Row count is estimated. Validate with a post-load COUNT(*) query."),
        F.when(nested, "Nested JSON detected. Expect flattening or OPENJSON WITH (...) work before production load."),
        F.when(long, "Very long strings detected. Consider NVARCHAR(MAX) columns and downstream truncation checks."),
        F.when(F.size(numeric) > 0, F.concat(
            F.lit("Nullable numeric columns detected: "), F.array_join(F.slice(numeric, 1, 5), ", "),
            F.lit(". Stage as text if source quality is inconsistent."))),
    ))


def profile_warnings(profiles: DataFrame) -> DataFrame:
    """Warnings per file (``path, position, warning``); files without any have no rows."""
    listed = profiles.select("path", F.posexplode(warnings_of(profiles)).alias("position", "warning"))
    return listed.withColumn("position", F.col("position") + 1)
