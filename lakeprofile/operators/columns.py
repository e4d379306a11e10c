"""Column-level operators over whole tables: one pass for all columns, then one row per column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lakeprofile.functions import cells
from lakeprofile.functions.lookup import look_up
from lakeprofile.functions.names import safe_sql_type
from lakeprofile.functions.sqltypes import sized_length, string_type


def _rows_from_aggregates(df: DataFrame, aggregates: dict[str, dict[str, Column]]) -> DataFrame:
    """Runs ``{column: {measure: aggregate}}`` in one aggregation and turns the single wide row into long form."""
    wide = df.agg(*[
        F.struct(*[measure.alias(label) for label, measure in measures.items()]).alias(f"c{position}")
        for position, measures in enumerate(aggregates.values())
    ])
    entries = [
        F.struct(F.lit(position + 1).alias("ordinal"), F.lit(name).alias("name"),
                 F.col(f"c{position}").alias("measures"))
        for position, name in enumerate(aggregates)
    ]
    return wide.select(F.inline(F.array(*entries))).select("ordinal", "name", "measures.*")


def string_widths(df: DataFrame) -> DataFrame:
    """Longest value per string column, its sized length and SQL type; 0 where all values are missing."""
    names = [field.name for field in df.schema if isinstance(field.dataType, T.StringType)]
    widths = _rows_from_aggregates(
        df, {name: {"observed": F.max(F.length(F.col(f"`{name}`")))} for name in names}
    )
    observed = F.coalesce("observed", F.lit(0)).cast("bigint")
    return widths.select(
        "name", observed.alias("observed_max_len"), sized_length(observed).alias("sized_len"),
        string_type(sized_length(observed)).alias("sql_type"),
    )


def infer_types(df: DataFrame, null_words: list[str] | None = None) -> DataFrame:
    """Detected type per column of an all-text table, over every row."""
    # Classes are told first, once per cell; the aggregation then only compares small numbers.
    classes = df.select(*[
        cells.cell_class(cells.null_if_blank(F.col(f"`{name}`"), null_words)).alias(name) for name in df.columns
    ])
    found = _rows_from_aggregates(classes, {
        name: {"lowest": F.min(F.col(f"`{name}`")), "highest": F.max(F.col(f"`{name}`")),
               "values": F.count(F.col(f"`{name}`")), "rows": F.count(F.lit(1))}
        for name in df.columns
    })
    nulls = F.col("rows") - F.col("values")
    detected = cells.column_type(F.col("lowest"), F.col("highest"), nulls > 0)
    # An empty table says nothing about its columns.
    return found.select("ordinal", "name", F.when(F.col("rows") == 0, "object").otherwise(detected)
                        .alias("detected_type"), nulls.alias("null_count"))


def null_distribution(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Missing values per column; all columns unless named."""
    names = list(names or df.columns)
    return _rows_from_aggregates(df, {name: {"nulls": F.count_if(F.col(f"`{name}`").isNull())} for name in names})


def duplicate_names(headers: DataFrame) -> DataFrame:
    """Names that occur twice in one header when case is ignored (``path``, ``names``): one row per such name."""
    folded = F.transform("names", F.lower)
    repeated = F.array_distinct(F.filter(
        folded, lambda name: F.size(F.filter(folded, lambda other: other == name)) > 1
    ))
    return headers.select("path", F.explode(repeated).alias("name"))


def first_rows(df: DataFrame, file: str, order_by: str, limit: int) -> DataFrame:
    """First rows per file.

    Spark cuts each partition to ``limit`` rows per file before it shuffles (for limits up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``), so a huge file never meets in one task.
    """
    rank = F.row_number().over(Window.partitionBy(file).orderBy(order_by))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= limit).drop("__rank")


def apply_overrides(df: DataFrame, overrides: dict[str, dict]) -> DataFrame:
    """Excludes, renames and retypes columns; order is kept and settings follow the original name.

    ``overrides``: column -> any of ``excluded``, ``name``, ``type`` (Spark type), ``nullable``. A missing value in a
    column declared not null fails the job.
    """
    kept = []
    for name in df.columns:
        change = overrides.get(name, {})
        if change.get("excluded"):
            continue
        column = F.col(f"`{name}`")
        if "type" in change:
            column = column.try_cast(change["type"])
        if change.get("nullable") is False:
            column = F.coalesce(column, F.raise_error(F.lit(f"null in required column {name}")))
        kept.append(column.alias(change.get("name", name)))
    return df.select(*kept)


def override_profiles(profiles: DataFrame, overrides: dict[str, dict]) -> DataFrame:
    """The same changes made to profiled columns, so that definitions follow them.

    ``type`` is an SQL type here; one that does not look like a type becomes a wide string.
    """
    setting = lambda key: {name: change[key] for name, change in overrides.items() if key in change}
    excluded = [name for name, change in overrides.items() if change.get("excluded")]
    renamed, typed = setting("name"), setting("type")
    nullable = {name: str(value).lower() for name, value in setting("nullable").items()}

    def changed(column: Column, position: Column) -> Column:
        name = column["name"]
        updated = column.withField("ordinal", (position + 1).cast("int"))
        if nullable:
            updated = updated.withField("nullable", F.coalesce(look_up(name, nullable) == "true", column["nullable"]))
        if typed:
            asked = look_up(name, typed)
            updated = updated.withField(
                "sql_type", F.when(asked.isNotNull(), safe_sql_type(asked)).otherwise(column["sql_type"])
            )
        if renamed:
            updated = updated.withField("name", F.coalesce(look_up(name, renamed), name))
        return updated

    kept = F.filter("columns", lambda column: ~column["name"].isin(*excluded)) if excluded else F.col("columns")
    return profiles.withColumn("columns", F.transform(kept, changed))


def schema_of_columns(columns: Iterable[tuple[str, str]]) -> T.StructType:
    """Schema from (name, Spark type) pairs given by hand; repeated names are refused."""
    columns = list(columns)
    folded = [name.casefold() for name, _ in columns]
    repeated = [name for name, _ in columns if folded.count(name.casefold()) > 1]
    if repeated:
        raise ValueError(f"Duplicate column name: {repeated[0]}")
    return T.StructType([T.StructField(name, T._parse_datatype_string(kind)) for name, kind in columns])
