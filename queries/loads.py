"""External tables and views, loads, checks and written layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lakeprofile.operators import export, loading
from lakeprofile.plans import reading
from lakeprofile.session import scratch_path
from lakeprofile.sources.delimited import read_delimited, read_with_rejects
from queries.fixtures import csv_of, once, table
from queries.text import LINEITEM_TEXT, ORDERS


def fresh_name(spark: SparkSession, label: str) -> str:
    return f"{label}_{scratch_path(spark, label).split('/')[-2]}"


def orders_schema() -> T.StructType:
    return T.StructType.fromDDL(ORDERS)


def external_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loading.external_table(
        spark, fresh_name(spark, "external_orders"), csv_of(spark, sf_dir, "orders"), "csv", orders_schema(),
        header=True, **LINEITEM_TEXT,
    )


def external_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loading.external_view(
        spark, fresh_name(spark, "view_orders"), csv_of(spark, sf_dir, "orders"), "csv", ORDERS, header="true",
        **LINEITEM_TEXT,
    )


def wildcard_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every data file below a folder, however deep."""

    def write(path: str) -> None:
        table(spark, sf_dir, "orders").withColumn("p", F.col("o_orderstatus")).write.partitionBy("p").parquet(f"{path}/a/b")

    path = once(spark, sf_dir, "nested-orders", write)
    return reading.read_location(spark, path).drop(reading.FILE_PATH)


def orc_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = once(spark, sf_dir, "orders-orc", lambda where: table(spark, sf_dir, "orders").write.orc(where))
    return spark.read.orc(path)


def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_quantity < 10").select("l_orderkey", "l_linenumber", "l_quantity")


def empty_target(spark: SparkSession, label: str, schema: T.StructType) -> str:
    name = fresh_name(spark, label)
    spark.catalog.createTable(name, path=scratch_path(spark, label), source="parquet", schema=schema)
    return name


def dirty_csv(spark: SparkSession, sf_dir: str) -> str:
    """Orders as delimited lines; every hundredth has a key that is no number."""

    def write(path: str) -> None:
        bad = F.when(F.col("o_orderkey") % 100 == 0, F.concat(F.lit("x"), "o_orderkey")).otherwise(
            F.col("o_orderkey").cast("string"))
        table(spark, sf_dir, "orders").select(
            F.concat_ws(",", bad, "o_custkey", "o_orderstatus").alias("value")).write.text(path)

    return once(spark, sf_dir, "dirty-orders", write)


DIRTY = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()),
])


def bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load without rejects into an existing table."""
    target = empty_target(spark, "bulk_orders", orders_schema())
    loading.bulk_load(spark, csv_of(spark, sf_dir, "orders"), target, orders_schema(), **LINEITEM_TEXT)
    return spark.table(target)


def tolerant_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load that may reject rows: good rows arrive, rejects are counted."""
    target = empty_target(spark, "tolerant_orders", DIRTY)
    allowed = table(spark, sf_dir, "orders").count()
    rejected = loading.bulk_load(spark, dirty_csv(spark, sf_dir), target, DIRTY, max_errors=allowed, has_header=False)
    return spark.table(target).withColumn("rejected", F.lit(rejected).cast("bigint"))


def refused_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load over its limit leaves the table empty."""
    target = empty_target(spark, "refused_orders", DIRTY)
    try:
        loading.bulk_load(spark, dirty_csv(spark, sf_dir), target, DIRTY, max_errors=0, has_header=False)
        refused = False
    except loading.RejectLimitExceeded:
        refused = True
    return spark.table(target).agg(F.count("*").alias("rows")).withColumn("refused", F.lit(refused))


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_with_rejects(spark, dirty_csv(spark, sf_dir), DIRTY, has_header=False)
    return rows.filter("_rejected IS NOT NULL").select("o_custkey", F.col("_rejected").alias("line"))


def ctas_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_delimited(spark, csv_of(spark, sf_dir, "orders"), ORDERS, **LINEITEM_TEXT)
    return loading.load_into_new(rows, fresh_name(spark, "new_orders"), scratch_path(spark, "new-orders"))


def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads into one table: rows add up."""
    target = empty_target(spark, "appended_orders", orders_schema())
    rows = read_delimited(spark, csv_of(spark, sf_dir, "orders"), ORDERS, **LINEITEM_TEXT)
    loading.load_into_existing(rows.filter("o_orderkey % 2 = 0"), target)
    return loading.load_into_existing(rows.filter("o_orderkey % 2 = 1"), target)


def validate_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = table(spark, sf_dir, "customer").select(
        "c_custkey", F.nullif("c_name", F.lit("Customer#000000001")).alias("c_name"),
        F.expr("CASE WHEN c_nationkey > 3 THEN c_nationkey END").alias("c_nationkey"), "c_mktsegment",
    )
    return loading.validate_load(loaded)


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics the optimizer keeps for the key columns of a loaded table."""
    name = fresh_name(spark, "measured_orders")
    loading.load_into_new(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), name,
                          scratch_path(spark, "measured-orders"))
    statistics = loading.column_statistics(spark, name)
    return statistics.filter("statistic IN ('min', 'max', 'num_nulls')").select(
        "column", "statistic", F.col("value").cast("bigint").alias("value")
    )


def partitioned_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orders-by-status")
    export.partitioned_write(table(spark, sf_dir, "orders"), path, "o_orderstatus", sort_by="o_orderkey")
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_orderstatus")


QUERIES = {
    "external_table": external_table,
    "external_view": external_view,
    "wildcard_scan": wildcard_scan,
    "orc_scan": orc_scan,
    "parquet_scan": parquet_scan,
    "bulk_load": bulk_load,
    "tolerant_load": tolerant_load,
    "refused_load": refused_load,
    "rejected_rows": rejected_rows,
    "ctas_load": ctas_load,
    "insert_select": insert_select,
    "validate_load": validate_load,
    "column_stats": column_stats,
    "partitioned_write": partitioned_write,
}
_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"
ORACLES = {
    "external_table": _ORDERS,
    "external_view": _ORDERS,
    "wildcard_scan": _ORDERS,
    "orc_scan": _ORDERS,
    "parquet_scan": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 10",
    "bulk_load": _ORDERS,
    "tolerant_load": """
        SELECT o_orderkey, o_custkey, o_orderstatus, (SELECT count(*) FROM orders WHERE o_orderkey % 100 = 0) AS rejected
        FROM orders WHERE o_orderkey % 100 <> 0""",
    "refused_load": "SELECT 0::BIGINT AS rows, true AS refused",
    "rejected_rows": """
        SELECT o_custkey, 'x' || o_orderkey || ',' || o_custkey || ',' || o_orderstatus AS line FROM orders WHERE o_orderkey % 100 = 0""",
    "ctas_load": _ORDERS,
    "insert_select": _ORDERS,
    "validate_load": """
        SELECT 'loaded_rows' AS "check", count(*) AS value FROM customer
        UNION ALL SELECT 'c_custkey_nulls', 0
        UNION ALL SELECT 'c_name_nulls', count(*) FROM customer WHERE c_name = 'Customer#000000001'
        UNION ALL SELECT 'c_nationkey_nulls', count(*) FROM customer WHERE c_nationkey <= 3""",
    "column_stats": """
        SELECT 'o_orderkey' AS "column", 'min' AS statistic, min(o_orderkey) AS value FROM orders
        UNION ALL SELECT 'o_orderkey', 'max', max(o_orderkey) FROM orders
        UNION ALL SELECT 'o_orderkey', 'num_nulls', 0
        UNION ALL SELECT 'o_custkey', 'min', min(o_custkey) FROM orders
        UNION ALL SELECT 'o_custkey', 'max', max(o_custkey) FROM orders
        UNION ALL SELECT 'o_custkey', 'num_nulls', 0""",
    "partitioned_write": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
}
