"""First rows of any file or table, as a DataFrame of its own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lakeprofile.functions.jsonfn import finite_or_null
from lakeprofile.lookups import PREVIEW_MAX_ROWS
from lakeprofile.plans.profile import profile_location
from lakeprofile.session import qualify, write_and_read
from lakeprofile.sources import tables
from lakeprofile.sources.delimited import csv_samples
from lakeprofile.sources.inventory import list_location
from lakeprofile.sources.workbook import workbook_samples


def clamp_rows(rows: int) -> int:
    return max(1, min(int(rows), PREVIEW_MAX_ROWS))


def json_safe(df: DataFrame) -> DataFrame:
    """Numbers without a JSON form become null; types without one become text."""
    plain = (T.StringType, T.BooleanType, T.IntegralType)
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            column = finite_or_null(column)
        elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            column = F.to_json(column)
        elif not isinstance(field.dataType, plain):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _table_files(spark: SparkSession, path: str) -> DataFrame:
    return list_location(spark, path).filter("kind = 'file' AND table_root IS NOT NULL")


def _some_paths(files: DataFrame, limit: int) -> list[str]:
    """A bounded number of paths for a reader on the driver."""
    return [row.path for row in files.orderBy("path").limit(limit).collect()]


def _spread_cells(sample: DataFrame) -> DataFrame:
    """The rows of one sampled file (at most ``PREVIEW_MAX_ROWS``) as columns of their own."""
    names = sample.select("names").first().names
    return sample.select(F.explode("rows").alias("row")).select(
        *[F.get("row", F.lit(at)).alias(name) for at, name in enumerate(names)]
    )


def preview(spark: SparkSession, path: str, rows: int = 100) -> DataFrame:
    """First rows of one file or table folder. ``rows`` is held between 1 and 10000."""
    rows = clamp_rows(rows)
    path = qualify(spark, path)
    profile = profile_location(spark, path).select("file_type", "encoding", "json_format", "columns", "error").first()
    kind = profile.file_type
    if profile.error and kind not in ("delta", "iceberg"):
        raise ValueError(profile.error)
    if kind == "csv":
        one_file = spark.createDataFrame([(path, profile.encoding)], "path string, encoding string")
        found = _spread_cells(csv_samples(one_file, rows))
    elif kind == "parquet":
        found = spark.read.parquet(path)
    elif kind == "orc":
        found = spark.read.orc(path)
    elif kind == "delta":
        files = _table_files(spark, path)
        actions = tables.delta_actions(files)
        broken = actions.filter("problem IS NOT NULL").select("table_root").distinct()
        live = write_and_read(tables.delta_data_files(actions.join(broken, "table_root", "left_anti")), "preview-live")
        # Files that hold rows, as many as rows were asked for; the rest of the snapshot is never opened.
        left = F.coalesce("num_records", F.lit(1)) - F.when(F.col("vector").isNotNull() & F.col("num_records").isNotNull(), F.col("vector.cardinality")).otherwise(0)
        chosen = live.filter(F.coalesce(left > 0, F.lit(True))).orderBy("path").limit(rows)
        if not chosen.isEmpty():
            found = tables.read_live(spark, path, chosen)
        else:
            first = _some_paths(tables.first_data_files(files), 1)
            if not first:
                raise ValueError("No underlying Parquet data file found")
            found = spark.read.parquet(*first)
    elif kind == "iceberg":
        chosen = _some_paths(tables.first_data_files(_table_files(spark, path), below="data"), 1)
        found = spark.read.parquet(*chosen) if chosen else spark.createDataFrame([], T.StructType())
    elif kind == "json":
        # Every member is read as text under the sampled keys: no inference pass, nothing lost to a type.
        members = T.StructType([T.StructField(column.name, T.StringType()) for column in profile.columns])
        found = spark.read.schema(members).option("multiLine", profile.json_format != "ndjson").json(path)
    elif kind == "excel":
        found = _spread_cells(workbook_samples(spark.createDataFrame([(path,)], "path string"), rows))
    else:
        found = spark.read.text(path).select(F.regexp_replace("value", r"\s+$", "").alias("line"))
    return json_safe(found.limit(rows))


def preview_info(profiles: DataFrame, rows: int = 100) -> DataFrame:
    """What a preview of each profiled file shows: its columns, the rows there are, and whether some are left out."""
    shown = clamp_rows(rows)
    more = F.col("analysis_truncated") | F.coalesce(F.col("row_count") > shown, F.lit(False))
    return profiles.select(
        "path", F.transform("columns", lambda c: F.struct(c["name"].alias("name"), c["detected_type"].alias("type")))
        .alias("columns"),
        F.col("row_count").alias("total_rows"), more.alias("truncated"), "error",
    )
