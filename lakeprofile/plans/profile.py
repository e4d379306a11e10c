"""Profile of every file in a location: one row per file, columns nested in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakeprofile.functions.encodings import BYTE_ORDER_MARKS, codepage, encoding_warning
from lakeprofile.functions.paths import path_suffix, type_by_extension
from lakeprofile.functions.sqltypes import spark_type, sql_type
from lakeprofile.lookups import ENCODING_SAMPLE_BYTES
from lakeprofile.session import write_and_read
from lakeprofile.sources import arrays, documents, orc, parquet, tables, workbook
from lakeprofile.sources.chunks import CHUNK_BYTES, line_counts, record_counts
from lakeprofile.sources.delimited import COLUMNS, HEAD_ROWS, csv_samples, whole_columns
from lakeprofile.sources.dialects import with_dialects
from lakeprofile.sources.encoding import whole_encodings
from lakeprofile.sources.heads import sniffed
from lakeprofile.sources.inventory import (
    collapse_tables, describe_entries, list_level, list_location, list_paths,
)

TEXT_TYPES = ("csv", "text", "json")
PARQUET_INFO = (
    "struct<created_by:string,num_row_groups:bigint,format_version:string,serialized_size:bigint,"
    "key_value_metadata:map<string,string>>"
)
DELTA_INFO = (
    "struct<version:bigint,name:string,description:string,partition_columns:array<string>,created_time:bigint,"
    "configuration:map<string,string>,data_files:bigint>"
)
ICEBERG_INFO = (
    "struct<format_version:bigint,table_uuid:string,location:string,last_updated:bigint,current_schema_id:bigint,"
    "default_spec_id:bigint,partition_spec:string,metadata_file:string>"
)
# Columns every branch of the profile produces, with their types.
PROFILE = {
    "path": "string",
    "row_count": "bigint",
    "columns": COLUMNS,
    "delimiter": "string",
    "has_header": "boolean",
    "quoted_breaks": "boolean",
    "compression": "string",
    "json_format": "string",
    "schema_inference": "string",
    "schema_sample_size": "bigint",
    "nullability_inference": "string",
    "analysis_truncated": "boolean",
    "sample_rows": "array<array<string>>",
    "row_count_lower_bound": "bigint",
    "warning": "string",
    "error": "string",
    "parquet": PARQUET_INFO,
    "delta": DELTA_INFO,
    "iceberg": ICEBERG_INFO,
}


def _branch(df: DataFrame, **columns: Column) -> DataFrame:
    """A branch's columns in the common layout, nulls where it has none."""
    return df.select(*[
        columns[name].cast(kind).alias(name) if name in columns else F.expr(f"CAST(NULL AS {kind}) AS {name}")
        for name, kind in PROFILE.items()
    ])


def _csv(files: DataFrame, chunk_bytes: int) -> DataFrame:
    # The head tells the dialect of short files and the names; the delimiter of others, types, widths and gaps come from every record.
    heads = write_and_read(csv_samples(with_dialects(files, chunk_bytes), HEAD_ROWS), "csv-heads")
    readable = heads.filter("sample_error IS NULL")
    counts = record_counts(files.join(readable.select("path", "delimiter"), "path"), chunk_bytes).withColumnRenamed("error", "count_error")
    judged = write_and_read(
        heads.join(files.select("path", "encoding"), "path").join(counts, "path", "left"), "csv-counts")
    columns = whole_columns(judged.filter("sample_error IS NULL AND count_error IS NULL"))
    return _branch(
        judged.join(columns, "path", "left"),
        path=F.col("path"),
        row_count=F.greatest(F.col("records") - F.when(F.col("has_header"), 1).otherwise(0), F.lit(0)),
        columns=F.col("columns"),
        delimiter=F.col("delimiter"),
        has_header=F.col("has_header"),
        quoted_breaks=F.col("quoted_breaks"),
        schema_inference=F.when(F.col("columns").isNotNull(), "full"),
        schema_sample_size=F.col("examined"),
        nullability_inference=F.lit("conservative"),
        sample_rows=F.slice("rows", 1, 3),
        warning=F.when(F.col("too_long") > 0, F.format_string("Skipped %d lines with too many fields.", "too_long")),
        error=F.coalesce("sample_error", "count_error"),
    )


def _json(files: DataFrame, chunk_bytes: int) -> DataFrame:
    explicit = path_suffix("path").isin(".jsonl", ".ndjson")
    candidates = files.filter(explicit | (F.col("first_char") == "{")).select("path", "size", "encoding")
    lines = documents.document_line_counts(candidates, chunk_bytes).withColumnRenamed("error", "line_error")
    judged = write_and_read(
        files.select("path", "size", "encoding", "first_char").join(lines, "path", "left").withColumn(
            "line_format",
            documents.line_format(explicit, F.col("objects"), F.col("invalid"), F.col("other")),
        ),
        "json-lines",
    )
    by_line = judged.filter("line_format IS NOT NULL").select("path", "size", "encoding")
    # An array longer than a chunk is read in ranges; other documents are parsed whole, by one task each.
    is_long = (F.col("first_char") == "[") & (F.col("size") > chunk_bytes) & F.col("encoding").isin("ascii", "utf-8", "utf-8-sig")
    others = judged.filter("line_format IS NULL")
    shapes = documents.document_shapes(others.filter(~F.coalesce(is_long, F.lit(False))))
    objects = documents.line_objects(by_line, chunk_bytes)
    long = others.filter(is_long)
    if not long.isEmpty():
        elements = write_and_read(arrays.array_elements(long, chunk_bytes), "json-elements")
        shapes = shapes.unionByName(documents.array_shapes(elements))
        objects = objects.unionByName(documents.array_objects(elements))
    shapes = write_and_read(shapes, "json-documents")
    objects = objects.unionByName(documents.shape_objects(shapes))
    found = judged.join(shapes.drop("objects"), "path", "left").join(documents.document_columns(objects), "path", "left")
    row_count = F.when(F.col("line_format").isNotNull(), F.col("objects")).otherwise(F.col("document_rows"))
    skipped = F.when(F.col("line_format").isNotNull() & (F.col("invalid") > 0),
                     F.when(F.col("invalid") == 1, "Skipped 1 invalid NDJSON line.").otherwise(
                         F.format_string("Skipped %d invalid NDJSON lines.", "invalid")))
    known = F.col("sampled") > 0
    return _branch(
        found,
        path=F.col("path"),
        row_count=row_count,
        columns=F.col("columns"),
        has_header=F.when(known, F.lit(True)),
        json_format=F.coalesce("line_format", "document_format"),
        # Elements that are no objects have no columns.
        schema_inference=F.when(known, F.when(row_count > F.col("sampled"), "sampled").otherwise("full")),
        schema_sample_size=F.col("sampled"),
        nullability_inference=F.when(known, "conservative"),
        warning=skipped,
        error=F.coalesce("line_error", "error"),
    )


def _text(files: DataFrame, chunk_bytes: int) -> DataFrame:
    counts = line_counts(files, chunk_bytes)
    return _branch(counts, path=F.col("path"), row_count=F.col("row_count"), error=F.col("error"))


def _parquet(files: DataFrame) -> DataFrame:
    return _branch(
        parquet.footers(files),
        path=F.col("path"), row_count=F.col("row_count"), columns=parquet.footer_columns(F.col("fields")),
        compression=F.col("compression"), error=F.col("error"),
        parquet=F.when(F.col("error").isNull(), F.struct("created_by", "num_row_groups", "format_version",
                                                         "serialized_size", "key_value_metadata")),
    )


def _orc(files: DataFrame) -> DataFrame:
    return _branch(
        orc.footers(files),
        path=F.col("path"), row_count=F.col("row_count"), columns=parquet.footer_columns(F.col("fields")), compression=F.col("compression"),
        error=F.col("error"),
    )


def _delta(roots: DataFrame, table_files: DataFrame) -> DataFrame:
    files = table_files.filter("table_type = 'delta'")
    replayed = write_and_read(tables.delta_tables(files), "delta-tables")
    unread = roots.select(F.col("path").alias("table_root")).join(
        replayed.select(F.col("path").alias("table_root")), "table_root", "left_anti"
    )
    fallback_files = unread.join(files.select("table_root", F.col("path")), "table_root", "left").select(
        "table_root", F.coalesce("path", F.lit("")).alias("path")
    )
    fallback = tables.table_fallback(fallback_files)
    from_log = _branch(replayed, path=F.col("path"), row_count=F.col("row_count"), columns=F.col("columns"),
                       delta=F.col("delta"))
    from_file = _branch(fallback, path=F.col("path"), columns=F.col("columns"), compression=F.col("compression"),
                        warning=F.col("warning"), schema_inference=F.col("schema_inference"), error=F.col("error"))
    return from_log.unionByName(from_file)


def _iceberg(table_files: DataFrame) -> DataFrame:
    found = tables.iceberg_tables(table_files.filter("table_type = 'iceberg'"))
    return _branch(found, path=F.col("path"), row_count=F.col("row_count"), columns=F.col("columns"),
                   iceberg=F.col("iceberg"), schema_inference=F.lit("iceberg_metadata"), error=F.col("error"))


def _excel(files: DataFrame) -> DataFrame:
    # The sample gives the names and the rows to show; counts, types, widths and gaps come from every cell.
    samples = write_and_read(workbook.workbook_samples(files), "workbook-samples")
    contents = workbook.workbook_contents(samples.filter("error IS NULL"))
    judged = samples.join(contents, "path", "left").withColumn("error", F.coalesce("error", "cells_error"))
    good = F.col("error").isNull()
    # A sheet without cells has no contents.
    judged = judged.withColumns({
        "row_count": F.when(good, F.coalesce("row_count", F.lit(0))),
        "names": F.when(good, workbook.all_names(F.col("names"), F.col("width"))),
    })
    return _branch(
        judged,
        path=F.col("path"),
        row_count=F.col("row_count"),
        columns=workbook.workbook_columns(F.col("names"), F.col("row_count"), F.col("stats")),
        has_header=F.when(F.col("error").isNull(), F.lit(True)),
        schema_inference=F.lit("full"),
        schema_sample_size=F.col("row_count"),
        nullability_inference=F.lit("conservative"),
        sample_rows=F.slice("rows", 1, 3),
        error=F.col("error"),
    )


def typed_entries(entries: DataFrame, whole: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Inventory with ``file_type``; leading bytes are read for text formats and unknown extensions.

    With ``whole`` the encoding of a text file is told from all its bytes; else it is that of its leading bytes.
    """
    by_name = entries.filter("kind IN ('file', 'table')").withColumn(
        "file_type", F.coalesce("table_type", type_by_extension("name"))
    )
    unsure = by_name.filter(F.col("file_type").isNull() | F.col("file_type").isin(*TEXT_TYPES))
    if unsure.isEmpty():
        # Nothing but self-describing formats: no bytes to read.
        nothing = F.lit(None).cast("string")
        return by_name.withColumns({
            "encoding": F.lit("binary"), "encoding_confidence": F.lit(1.0), "first_char": nothing,
            "head_error": nothing,
        })
    typed = by_name.join(sniffed(unsure), "path", "left").withColumn(
        "file_type", F.coalesce("sniffed_type", "file_type")
    )
    is_text = F.col("file_type").isin(*TEXT_TYPES)
    told = typed.withColumns({
        "encoding": F.when(is_text, F.col("encoding")).otherwise("binary"),
        "encoding_confidence": F.when(is_text, F.col("encoding_confidence")).otherwise(1.0),
    }).drop("sniffed_type")
    # Every branch of the profile starts here: the bytes are read once.
    told = write_and_read(told, "typed-entries")
    # A mark at the start, or a file no longer than what was read of it, leaves nothing open.
    marked = F.col("encoding").isin(*[name for _, name in BYTE_ORDER_MARKS])
    longer = told.filter(F.col("file_type").isin(*TEXT_TYPES) & F.col("head_error").isNull() & ~marked & (F.col("size") > ENCODING_SAMPLE_BYTES))
    if not whole or longer.isEmpty():
        return told
    of_all = whole_encodings(longer, chunk_bytes).select(
        "path", F.col("encoding").alias("of_all"), F.col("confidence").alias("of_all_confidence"), F.col("error").alias("of_all_error"))
    return write_and_read(told.join(of_all, "path", "left").withColumns({
        "encoding": F.coalesce("of_all", "encoding"), "encoding_confidence": F.coalesce("of_all_confidence", "encoding_confidence"),
        "head_error": F.coalesce("head_error", "of_all_error"),
    }).drop("of_all", "of_all_confidence", "of_all_error"), "typed-entries-whole")


def profile_listing(listing: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Profiles of all entries of a listing (see ``list_location``)."""
    entries = describe_entries(collapse_tables(listing))
    typed = typed_entries(entries, whole=True, chunk_bytes=chunk_bytes)
    table_files = listing.filter(F.col("table_root").isNotNull() & (F.col("kind") == "file")).select(
        "table_root", "table_type", "path", "size", "modified"
    )
    # Branches are only planned for types that occur; the distinct types are at most a dozen.
    present = {row.file_type for row in typed.select("file_type").distinct().collect()}

    def of_type(file_type: str) -> DataFrame:
        return typed.filter(F.col("file_type") == file_type)

    branches = {
        "csv": lambda: _csv(of_type("csv"), chunk_bytes),
        "json": lambda: _json(of_type("json"), chunk_bytes),
        "text": lambda: _text(of_type("text"), chunk_bytes),
        "parquet": lambda: _parquet(of_type("parquet")),
        "orc": lambda: _orc(of_type("orc")),
        "delta": lambda: _delta(of_type("delta").filter("is_table_root"), table_files),
        "iceberg": lambda: _iceberg(table_files),
        "excel": lambda: _excel(of_type("excel")),
    }
    found = _branch(typed.limit(0), path=F.col("path"))
    for file_type, build in branches.items():
        if file_type in present:
            found = found.unionByName(build())
    return _finish(typed.withColumnRenamed("error", "entry_error"), found, entries)


def _finish(typed: DataFrame, found: DataFrame, entries: DataFrame) -> DataFrame:
    unlisted = entries.filter("kind = 'error'").select(
        "root", "path", "name", "size", "modified", "kind", F.lit("unknown").alias("file_type"),
        F.lit(None).cast("string").alias("encoding"), F.lit(None).cast("double").alias("encoding_confidence"),
        F.col("error").alias("entry_error"),
    )
    basics = typed.select(
        "root", "path", "name", "size", "modified", "kind", "file_type", "encoding", "encoding_confidence",
        F.coalesce("entry_error", "head_error").alias("entry_error"),
    ).unionByName(unlisted)
    is_text = F.col("file_type").isin(*TEXT_TYPES)
    details = [name for name in PROFILE if name not in ("path", "columns", "error", "has_header",
                                                        "analysis_truncated")]
    columns = F.transform(
        "columns",
        lambda c: F.struct(
            c["ordinal"].alias("ordinal"), c["name"].alias("name"), c["detected_type"].alias("detected_type"),
            F.coalesce(c["spark_type"], spark_type(c["detected_type"])).alias("spark_type"),
            sql_type(c["detected_type"], c["sized_len"]).alias("sql_type"), c["nullable"].alias("nullable"),
            c["nesting"].alias("nesting"), c["observed_max_len"].alias("observed_max_len"),
            c["sized_len"].alias("sized_len"), c["sample_value"].alias("sample_value"),
        ),
    )
    return basics.join(found, "path", "left").select(
        "root", "path", "name", "file_type", "size", "modified", "encoding",
        F.round(F.col("encoding_confidence") * 100).cast("bigint").alias("encoding_confidence"),
        F.when(F.col("encoding").isNotNull(), codepage("encoding")).alias("codepage"),
        F.when(is_text, encoding_warning("encoding", "encoding_confidence")).alias("encoding_warning"),
        F.coalesce("has_header", F.lit(False)).alias("has_header"),
        F.coalesce("analysis_truncated", F.lit(False)).alias("analysis_truncated"),
        F.lit(False).alias("row_count_estimated"),
        F.size("columns").cast("bigint").alias("column_count"),
        columns.alias("columns"),
        *details,
        F.coalesce("error", "entry_error").alias("error"),
    )


def location_listing(spark: SparkSession, location: str) -> DataFrame:
    """Everything at a location, hidden files included; an empty location gives one error row."""
    listing = list_location(spark, location)
    if listing.isEmpty():
        listing = spark.createDataFrame(
            [(location, location, "error", None, None, None, None, "No files found at the specified location")],
            listing.schema,
        )
    return listing


def profile_location(spark: SparkSession, location: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Profiles of everything at a location, hidden files included; an empty location gives one error row."""
    return profile_listing(location_listing(spark, location), chunk_bytes)


def profile_folder(spark: SparkSession, folder: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Profiles below a folder, without hidden folders and files of unknown type."""
    listing = list_location(spark, folder, prune_hidden=True)
    return profile_listing(listing, chunk_bytes).filter("file_type <> 'unknown' OR error IS NOT NULL")


def profile_paths(paths: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Profiles of an explicit list (``ordinal``, ``path``); one row per listed path, in its place."""
    profiles = profile_listing(list_paths(paths.select("path").distinct()), chunk_bytes)
    return paths.select("ordinal", F.col("path").alias("root")).join(profiles, "root")


def browse(spark: SparkSession, folder: str) -> DataFrame:
    """One directory level (``name, path, kind, file_type, size``): folders, table folders and files of a known type."""
    level = list_level(spark, folder)
    typed = typed_entries(level).filter("file_type <> 'unknown'").select("name", "path", "kind", "file_type", "size")
    folders = level.filter("kind = 'folder'").select(
        "name", "path", "kind", F.lit(None).cast("string").alias("file_type"), F.lit(0).cast("bigint").alias("size")
    )
    return typed.unionByName(folders)


def column_profiles(profiles: DataFrame) -> DataFrame:
    """One row per file and column."""
    return profiles.filter("columns IS NOT NULL").select("path", F.inline("columns"))


def location_summary(profiles: DataFrame, *more: Column) -> DataFrame:
    """Files, bytes, known rows and failures per file type, and any further aggregates."""
    return profiles.groupBy("file_type").agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        *more,
    )
