"""External tables and views, loads with a reject limit, checks after a load."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from lakeprofile.session import write_and_read
from lakeprofile.sources.delimited import REJECTED, read_with_rejects


class RejectLimitExceeded(ValueError):
    """More rows were rejected than the load allows."""


def _options_clause(options: dict) -> str:
    def quoted(value) -> str:
        return str(value).replace("\\", "\\\\").replace("'", "\\'")

    return ", ".join(f"'{name}' = '{quoted(value)}'" for name, value in options.items())


def external_table(spark: SparkSession, name: str, location: str, source: str, schema: T.StructType | None = None,
                   **options) -> DataFrame:
    """A named table over files in place. No rejected rows: a malformed record fails the query."""
    if source in ("csv", "json"):
        options = {"mode": "FAILFAST", **options}
    spark.catalog.createTable(name, path=location, source=source, schema=schema,
                              **{key: str(value) for key, value in options.items()})
    return spark.table(name)


def external_view(spark: SparkSession, name: str, location: str, source: str, columns: str = "", **options) -> DataFrame:
    """A temporary view over files in place; ``columns`` is a DDL column list where the files carry no schema."""
    clause = _options_clause({"path": location, **options})
    listed = f"({columns})" if columns else ""
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} {listed} USING {source} OPTIONS ({clause})")
    return spark.table(name)


def top_rows(df: DataFrame, limit: int, *order_by: str) -> DataFrame:
    """First rows; ordered where a column is named, so that the choice repeats."""
    return (df.orderBy(*order_by) if order_by else df).limit(limit)


def bulk_load(spark: SparkSession, path: str, table: str, schema: T.StructType, max_errors: int = 0,
              batch_rows: int | None = None, **dialect) -> int:
    """Loads delimited files into an existing table; returns the number of rejected rows.

    The text is parsed once: good rows go to columnar staging files in scratch space while rejects are counted, and are
    published from there. A load over its limit leaves the table untouched. ``batch_rows`` limits the rows of a written file;
    without it each task writes one.
    """
    rows = read_with_rejects(spark, path, schema, **dialect)
    rejected = F.col(REJECTED)
    seen = Observation()
    good = rows.observe(seen, F.count_if(rejected.isNotNull()).alias("errors")).filter(rejected.isNull())
    staged = write_and_read(good.select(*[F.col(f"`{name}`") for name in spark.table(table).columns]), "bulk-load")
    errors = seen.get["errors"]
    if errors > max_errors:
        raise RejectLimitExceeded(f"{errors} rejected rows in {path}, {max_errors} allowed")
    writer = staged.write if batch_rows is None else staged.write.option("maxRecordsPerFile", batch_rows)
    writer.insertInto(table)
    return errors


def load_into_new(df: DataFrame, table: str, location: str, source: str = "parquet") -> DataFrame:
    """Creates a table from rows (``SELECT INTO``)."""
    df.write.format(source).option("path", location).saveAsTable(table)
    return df.sparkSession.table(table)


def load_into_existing(df: DataFrame, table: str) -> DataFrame:
    """Appends rows to a table (``INSERT INTO ... SELECT``), columns matched by name."""
    target = df.sparkSession.table(table)
    df.select(*[F.col(f"`{name}`") for name in target.columns]).write.insertInto(table)
    return df.sparkSession.table(table)


def validate_load(loaded: DataFrame, columns: int = 3) -> DataFrame:
    """Row count and missing values of the first columns after a load, one row per check."""
    names = loaded.columns[:columns]
    counts = loaded.agg(
        F.count("*").alias("loaded_rows"),
        *[F.count_if(F.col(f"`{name}`").isNull()).alias(f"{name}_nulls") for name in names],
    )
    checks = [F.struct(F.lit(name).alias("check"), F.col(f"`{name}`").alias("value")) for name in counts.columns]
    return counts.select(F.inline(F.array(*checks)))


def column_statistics(spark: SparkSession, table: str) -> DataFrame:
    """Computes optimizer statistics for every column and returns them (``column, statistic, value``)."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
    parts = [
        spark.sql(f"DESCRIBE EXTENDED {table} `{name}`").select(F.lit(name).alias("column"), "*")
        for name in spark.table(table).columns
    ]
    described = parts[0]
    for part in parts[1:]:
        described = described.unionByName(part)
    wanted = ["min", "max", "num_nulls", "distinct_count", "avg_col_len", "max_col_len"]
    return described.filter(F.col("info_name").isin(*wanted)).select(
        "column", F.col("info_name").alias("statistic"), F.col("info_value").alias("value")
    )
