"""JSON columns and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from lakeprofile.functions import jsonfn
from lakeprofile.operators import json_columns
from lakeprofile.operators.export import export_document
from lakeprofile.operators.loading import load_into_existing
from lakeprofile.plans import reading
from lakeprofile.session import scratch_path, write_and_read
from lakeprofile.sources import documents as json_files
from lakeprofile.sources.arrays import array_elements
from lakeprofile.sources.chunks import read_lines
from lakeprofile.sources.inventory import inventory
from queries.writers import write_files
from queries.fixtures import JSON_DOCS, chunked, events_arrays, events_ndjson, json_docs, once, table


def isjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = json_docs(spark, sf_dir)
    odd = F.when(F.col("event_id") % 11 == 0, "42").when(F.col("event_id") % 13 == 0, '"text"').otherwise(F.col("doc"))
    return docs.select("event_id", jsonfn.is_json(odd).alias("is_json"))


def json_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_docs(spark, sf_dir).select(
        "event_id", jsonfn.json_value("doc", "$.type").alias("type"), jsonfn.json_value("doc", "$.id").alias("id"),
        jsonfn.json_value("doc", "$.props.k").alias("k"), jsonfn.json_value("doc", "$.props").alias("props"),
        jsonfn.json_value("doc", "$.tags[1]").alias("second_tag"), jsonfn.json_value("doc", "$.note").alias("note"),
    )


def json_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_docs(spark, sf_dir).select(
        "event_id", jsonfn.json_query("doc", "$.props").alias("props"), jsonfn.json_query("doc", "$.tags").alias("tags"),
        jsonfn.json_query("doc", "$.type").alias("type"),
    )


def json_path_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_docs(spark, sf_dir).select(
        "event_id", jsonfn.json_path_exists("doc", "$.note").alias("note"),
        jsonfn.json_path_exists("doc", "$.props.k").alias("k"), jsonfn.json_path_exists("doc", "$.gone").alias("gone"),
    )


def openjson_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonfn.with_json_entries(json_docs(spark, sf_dir), "doc").filter("key IS NOT NULL")


def openjson_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the nested object and elements of the nested list, next to their parent's key."""
    docs = json_docs(spark, sf_dir)
    members = jsonfn.with_json_entries(docs, "doc", path="$.props").withColumn("parent", F.lit("props"))
    elements = jsonfn.with_json_entries(docs, "doc", path="$.tags").withColumn("parent", F.lit("tags"))
    return members.unionByName(elements).filter("key IS NOT NULL")


OPENJSON_ROW = "array<struct<event_id:bigint,user_id:bigint,event_type:string,props:string>>"


def openjson_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of objects to typed rows; the nested member stays JSON text."""
    documents = chunked(table(spark, sf_dir, "events"), 100).groupBy("chunk").agg(
        F.to_json(F.collect_list(F.struct("event_id", "user_id", "event_type", F.parse_json("props").alias("props"))))
        .alias("doc")
    )
    return documents.select(F.inline(F.from_json("doc", OPENJSON_ROW)))


def json_modify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = json_docs(spark, sf_dir).filter("event_id % 7 <> 0")
    return docs.select(
        "event_id", jsonfn.json_set("doc", "type", F.lit("new_value")).alias("replaced"),
        jsonfn.json_set("doc", "extra", F.col("event_id")).alias("added"),
    )


def for_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("HOUSEHOLD")).alias("c_mktsegment")
    )
    return jsonfn.json_rows(customers, "c_custkey")


def for_json_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonfn.json_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", root="orders")


def for_json_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("HOUSEHOLD")).alias("c_mktsegment")
    )
    return jsonfn.json_rows(customers, "c_custkey", include_nulls=True)


def for_json_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "customer").orderBy("c_custkey").limit(1)
    return first.select(jsonfn.json_object("c_custkey", "c_name", "c_nationkey", "c_mktsegment").alias("doc"))


def json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return orders.select("o_orderkey", jsonfn.json_object("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
                         .alias("doc"))


def json_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("CASE event_id % 4 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') ELSE value END")
    return table(spark, sf_dir, "events").select("event_id", jsonfn.finite_or_null(value).alias("value"))


def json_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-delimited files with different members, read under one set of columns."""

    def write(path: str) -> None:
        events = table(spark, sf_dir, "events")
        events.filter("event_id % 2 = 0").select("event_id", "event_type").write.json(f"{path}/typed")
        events.filter("event_id % 2 = 1").select("event_id", "user_id").write.json(f"{path}/valued")

    path = once(spark, sf_dir, "json-union", write)
    return reading.read_location(spark, path).select("event_id", "event_type", "user_id")


def json_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar members of parsed documents, inserted into a table."""
    rows = openjson_typed(spark, sf_dir).select("event_id", "user_id", "event_type")
    target = "json_insert_" + spark.range(1).select(F.expr("replace(uuid(), '-', '')")).first()[0]
    spark.catalog.createTable(target, path=scratch_path(spark, "json-insert"), source="parquet",
                              schema=T.StructType([T.StructField("event_id", T.LongType()),
                                                   T.StructField("user_id", T.LongType()),
                                                   T.StructField("event_type", T.StringType())]))
    return load_into_existing(rows, target)


def clob_openjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files as one text each, then parsed."""
    documents = spark.read.text(single_documents(spark, sf_dir), wholetext=True)
    return documents.select(F.inline(F.from_json("value", OPENJSON_ROW)))


def single_documents(spark: SparkSession, sf_dir: str) -> str:
    """Events as JSON array files of at most 50000 elements, one document per file."""

    def write(path: str) -> None:
        events = chunked(table(spark, sf_dir, "events"), 50_000)
        element = F.struct("event_id", "user_id", "event_type", "props")
        documents = events.groupBy("chunk").agg(F.to_json(F.collect_list(element)).alias("value")).select("value")
        documents.write.option("maxRecordsPerFile", 1).text(path)

    return once(spark, sf_dir, "json-documents", write)


def json_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of array documents, number by number: key, whole element's members."""
    documents = spark.read.text(events_arrays(spark, sf_dir)).select(F.try_parse_json("value").alias("doc"))
    elements = documents.lateralJoin(spark.tvf.variant_explode(F.col("doc").outer()))
    member = lambda path, kind: F.try_variant_get("value", path, kind)
    return elements.select(
        member("$.event_id", "bigint").alias("event_id"), member("$.user_id", "bigint").alias("user_id"),
        member("$.event_type", "string").alias("event_type"), member("$.props", "string").alias("props"),
    )


def large_arrays(spark: SparkSession, sf_dir: str) -> str:
    """Events as array files, each of one document much longer than the chunks it is read in."""

    def write(path: str) -> None:
        events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
        write_files(events, path, ".json", lambda frame: frame.to_json(orient="records", indent=1).encode())

    return once(spark, sf_dir, "large-arrays", write)


def json_array_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of long array documents, found in byte ranges by many tasks a file; whether any file took several."""
    files = inventory(spark, large_arrays(spark, sf_dir)).filter("name LIKE 'part-%'")
    elements = write_and_read(array_elements(files, chunk_bytes=1 << 14), "json-array-ranges")
    several = elements.agg(F.max("chunk") > 0).first()[0]
    return elements.select(F.inline(F.array(F.from_json("text", "event_id bigint, user_id bigint, event_type string, props string")))).withColumn(
        "several", F.lit(several))


def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as one document by many tasks, sorted by price, and read back in byte ranges; whether they kept their order."""
    path = once(spark, sf_dir, "orders-document", lambda where: export_document(
        table(spark, sf_dir, "orders").drop("o_orderdate").repartition(8), f"{where}/orders.json", F.desc("o_totalprice"), "o_orderkey"))
    elements = array_elements(inventory(spark, path), chunk_bytes=1 << 16)
    rows = elements.select("chunk", "number", F.inline(F.array(F.from_json(
        "text", "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"))))
    # Ranges follow each other where the cheapest of one is no cheaper than the dearest of the next.
    ranges = rows.groupBy("chunk").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    falls = ranges.select((F.coalesce(F.lag("low").over(Window.orderBy("chunk")), F.col("high")) >= F.col("high")).alias("falls"))
    return rows.drop("chunk", "number").withColumn("in_order", falls.agg(F.bool_and("falls")).scalar())


def json_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements over all array documents."""
    documents = spark.read.text(events_arrays(spark, sf_dir))
    return documents.agg(F.sum(F.json_array_length("value")).alias("rows"))


NDJSON_ROW = "event_id bigint, user_id bigint, event_type string, props string, _rejected string"


def ndjson_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows of line-delimited files; lines that do not parse are left out."""
    lines = spark.read.schema(NDJSON_ROW).option("columnNameOfCorruptRecord", "_rejected").json(
        events_ndjson(spark, sf_dir), recursiveFileLookup=True
    )
    return lines.filter("_rejected IS NULL").drop("_rejected")


def ndjson_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid and invalid lines per event type, counted in byte ranges of every file."""
    files = inventory(spark, events_ndjson(spark, sf_dir)).filter("name LIKE 'part-%'")
    counts = json_files.document_line_counts(files.withColumn("encoding", F.lit("utf-8")))
    return counts.groupBy(F.regexp_extract("path", "event_type=([^/]*)/", 1).alias("event_type")).agg(
        F.sum("objects").alias("valid"), F.sum("invalid").alias("invalid")
    )


def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys over all documents, where they were first seen."""
    return json_columns.json_keys(json_docs(spark, sf_dir), "doc", "event_id")


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind and type per key from its first value that is not null."""
    return json_columns.json_fields(json_docs(spark, sf_dir), "doc", "event_id")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-delimited documents as one text column."""
    lines = spark.read.option("recursiveFileLookup", True).text(events_ndjson(spark, sf_dir))
    event_id = F.try_variant_get(F.try_parse_json("value"), "$.event_id", "bigint")
    return lines.select(event_id.alias("event_id"), F.length("value").cast("bigint").alias("chars"))


def json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by shape: lines of objects, one array, and how many rows they hold."""
    lines = inventory(spark, events_ndjson(spark, sf_dir)).withColumn("explicit", F.lit(True))
    arrays = inventory(spark, single_documents(spark, sf_dir)).withColumn("explicit", F.lit(False))
    files = lines.unionByName(arrays).filter("name LIKE 'part-%' AND size > 0").withColumn("encoding", F.lit("utf-8"))
    counts = json_files.document_line_counts(files)
    judged = write_and_read(files.join(counts.drop("error"), "path").withColumn(
        "line_format",
        json_files.line_format(F.col("explicit"), F.col("objects"), F.col("invalid"), F.col("other")),
    ), "json-shape")
    shapes = json_files.document_shapes(judged.filter("line_format IS NULL")).drop("error", "objects")
    rows = F.when(F.col("line_format").isNotNull(), F.col("objects")).otherwise(F.col("document_rows"))
    return judged.join(shapes, "path", "left").groupBy(F.coalesce("line_format", "document_format").alias("json_format")).agg(
        F.sum(rows).alias("rows"))


def json_array_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of array documents over all their elements, and how many documents have them."""
    files = inventory(spark, single_documents(spark, sf_dir)).filter("name LIKE 'part-%' AND size > 0").withColumn(
        "encoding", F.lit("utf-8"))
    objects = json_files.shape_objects(json_files.document_shapes(files))
    columns = json_files.document_columns(objects)
    return columns.select("sampled", F.explode("columns").alias("c")).groupBy("c.ordinal", "c.name", "c.detected_type").agg(
        F.sum("sampled").alias("elements"), F.max("c.observed_max_len").alias("longest"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every line-delimited file, read in byte ranges."""
    files = inventory(spark, events_ndjson(spark, sf_dir)).filter("name LIKE 'part-%'").withColumn(
        "encoding", F.lit("utf-8"))
    lines = read_lines(files, chunk_bytes=1 << 20)
    return lines.groupBy(F.regexp_extract("path", "event_type=([^/]*)/", 1).alias("event_type")).agg(
        F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars")
    )


QUERIES = {
    "isjson": isjson,
    "json_value": json_value,
    "json_query": json_query,
    "json_path_exists": json_path_exists,
    "openjson_kv": openjson_kv,
    "openjson_nested": openjson_nested,
    "openjson_typed": openjson_typed,
    "json_modify": json_modify,
    "for_json": for_json,
    "for_json_root": for_json_root,
    "for_json_nulls": for_json_nulls,
    "for_json_one": for_json_one,
    "json_object": json_object,
    "json_safe": json_safe,
    "json_union": json_union,
    "json_insert": json_insert,
    "clob_openjson": clob_openjson,
    "json_array_scan": json_array_scan,
    "json_array_ranges": json_array_ranges,
    "json_row_count": json_row_count,
    "json_document": json_document,
    "ndjson_scan": ndjson_scan,
    "ndjson_counts": ndjson_counts,
    "json_keys": json_keys,
    "json_fields": json_fields,
    "doc_lines": doc_lines,
    "json_shape": json_shape,
    "json_array_columns": json_array_columns,
    "text_lines": text_lines,
}

_VALID = f"(SELECT event_id, doc FROM ({JSON_DOCS}) WHERE json_valid(doc))"
_TYPE_CODE = ("CASE json_type({x}) WHEN 'NULL' THEN 0 WHEN 'VARCHAR' THEN 1 WHEN 'BOOLEAN' THEN 3 WHEN 'ARRAY' THEN 4 "
              "WHEN 'OBJECT' THEN 5 ELSE 2 END::BIGINT")
_COMPACT_PROPS = "replace(props, ' ', '')"
_CUSTOMER_BODY = """
    '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"'
    || CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN %s ELSE ',"c_mktsegment":"' || c_mktsegment || '"' END || '}'
"""
_FRAGMENTS = """
    SELECT {key}, CASE WHEN {key} = (SELECT min({key}) FROM {table}) THEN '{opening}' ELSE ',' END || {body}
                  || CASE WHEN {key} = (SELECT max({key}) FROM {table}) THEN '{closing}' ELSE '' END AS fragment
    FROM {table}
"""
# Length of one line of the event files, less the part cut off.
_EVENT_LINE = """
    length('{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '","props":"'
           || replace(props, '"', '\\"') || '"}') - CASE WHEN event_id % 7 = 0 THEN 3 ELSE 0 END
"""
_EVENT_ROWS = "SELECT event_id, user_id, event_type, props FROM events"

ORACLES = {
    "isjson": f"""
        SELECT event_id, json_valid(d) AND regexp_matches(d, '^\\s*[\\[{{]') AS is_json
        FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '42' WHEN event_id % 13 = 0 THEN '"text"' ELSE doc END AS d
              FROM ({JSON_DOCS}))""",
    "json_value": """
        SELECT event_id, CASE WHEN v THEN event_type END AS type, CASE WHEN v THEN event_id::VARCHAR END AS id,
               CASE WHEN v THEN json_extract_string(props, '$.k') END AS k, NULL::VARCHAR AS props,
               CASE WHEN v THEN user_id::VARCHAR END AS second_tag, NULL::VARCHAR AS note
        FROM (SELECT *, event_id % 7 <> 0 AS v FROM events)""",
    "json_query": f"""
        SELECT event_id, CASE WHEN v THEN {_COMPACT_PROPS} END AS props,
               CASE WHEN v THEN '["' || event_type || '",' || user_id || ']' END AS tags, NULL::VARCHAR AS type
        FROM (SELECT *, event_id % 7 <> 0 AS v FROM events)""",
    "json_path_exists": """
        SELECT event_id, event_id % 7 <> 0 AND event_id % 5 <> 0 AS note, event_id % 7 <> 0 AS k, false AS gone
        FROM events""",
    "openjson_kv": f"""
        SELECT event_id, k AS key,
               CASE json_type(value) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN json_extract_string(value, '$')
                                     ELSE value::VARCHAR END AS value,
               {_TYPE_CODE.format(x='value')} AS type
        FROM (SELECT event_id, k, json_extract(doc, '$."' || k || '"') AS value
              FROM (SELECT event_id, doc, unnest(json_keys(doc)) AS k FROM {_VALID}))""",
    "openjson_nested": """
        SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value, 2::BIGINT AS type, 'props' AS parent
        FROM events WHERE event_id % 7 <> 0
        UNION ALL SELECT event_id, '0', event_type, 1, 'tags' FROM events WHERE event_id % 7 <> 0
        UNION ALL SELECT event_id, '1', user_id::VARCHAR, 2, 'tags' FROM events WHERE event_id % 7 <> 0""",
    "openjson_typed": f"SELECT event_id, user_id, event_type, {_COMPACT_PROPS} AS props FROM events",
    "json_modify": f"""
        SELECT event_id, replace(d, '"type":"' || event_type || '"', '"type":"new_value"') AS replaced,
               substring(d, 1, length(d) - 1) || ',"extra":' || event_id || '}}' AS added
        FROM (SELECT event_id, event_type, replace(doc, props, {_COMPACT_PROPS}) AS d
              FROM ({JSON_DOCS}) JOIN events USING (event_id) WHERE event_id % 7 <> 0)""",
    "for_json": _FRAGMENTS.format(key="c_custkey", table="customer", opening="[", closing="]",
                                  body=_CUSTOMER_BODY % "''"),
    "for_json_root": _FRAGMENTS.format(
        key="o_orderkey", table="orders", opening='{"orders":[', closing="]}",
        body="""'{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}'"""),
    "for_json_nulls": _FRAGMENTS.format(key="c_custkey", table="customer", opening="[", closing="]",
                                        body=_CUSTOMER_BODY % "',\"c_mktsegment\":null'"),
    "for_json_one": """
        SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey
               || ',"c_mktsegment":"' || c_mktsegment || '"}' AS doc
        FROM customer ORDER BY c_custkey LIMIT 1""",
    "json_object": """
        SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":'
               || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END
               || ',"o_orderpriority":"' || o_orderpriority || '"}' AS doc
        FROM orders""",
    "json_safe": "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN NULL ELSE value END AS value FROM events",
    "json_union": """
        SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS event_type,
               CASE WHEN event_id % 2 = 1 THEN user_id END AS user_id
        FROM events""",
    "json_insert": "SELECT event_id, user_id, event_type FROM events",
    "clob_openjson": _EVENT_ROWS,
    "json_array_scan": _EVENT_ROWS,
    "json_array_ranges": "SELECT event_id, user_id, event_type, props, true AS several FROM events",
    "json_document": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, true AS in_order FROM orders",
    "json_row_count": "SELECT count(*) AS rows FROM events",
    "ndjson_scan": _EVENT_ROWS + " WHERE event_id % 7 <> 0",
    "ndjson_counts": """
        SELECT event_type, count(*) FILTER (event_id % 7 <> 0) AS valid, count(*) FILTER (event_id % 7 = 0) AS invalid
        FROM events GROUP BY event_type""",
    "json_keys": f"""
        SELECT k AS key, min(event_id) AS first_row, arg_min(pos, event_id) AS first_pos
        FROM (SELECT event_id, k, list_position(json_keys(doc), k)::BIGINT - 1 AS pos
              FROM (SELECT event_id, doc, unnest(json_keys(doc)) AS k FROM {_VALID}))
        GROUP BY k""",
    "json_fields": f"""
        SELECT k AS key,
               CASE json_type(v) WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'scalar' END AS kind,
               CASE json_type(v) WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' WHEN 'VARCHAR' THEN 'str'
                                 WHEN 'BOOLEAN' THEN 'bool' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END AS detected_type
        FROM (SELECT k, arg_min(v, event_id) AS v
              FROM (SELECT event_id, k, json_extract(doc, '$."' || k || '"') AS v
                    FROM (SELECT event_id, doc, unnest(json_keys(doc)) AS k FROM {_VALID}))
              WHERE json_type(v) <> 'NULL' GROUP BY k)""",
    "doc_lines": f"SELECT CASE WHEN event_id % 7 <> 0 THEN event_id END AS event_id, {_EVENT_LINE} AS chars FROM events",
    "json_shape": """
        SELECT 'ndjson' AS json_format, count(*) FILTER (event_id % 7 <> 0) AS rows FROM events
        UNION ALL SELECT 'array', count(*) FROM events""",
    "json_array_columns": """
        SELECT 1 AS ordinal, 'event_id' AS name, 'int' AS detected_type, count(*) AS elements, NULL::BIGINT AS longest FROM events
        UNION ALL SELECT 2, 'user_id', 'int', count(*), NULL FROM events
        UNION ALL SELECT 3, 'event_type', 'str', count(*), max(length(event_type)) FROM events
        UNION ALL SELECT 4, 'props', 'str', count(*), max(length(props)) FROM events""",
    "text_lines": f"SELECT event_type, count(*) AS lines, sum({_EVENT_LINE})::BIGINT AS chars FROM events GROUP BY event_type",
}
