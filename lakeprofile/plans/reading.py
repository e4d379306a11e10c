"""Rows of a location, read as its profile says.

Files are grouped by what a reader has to know (format, dialect, character set, header): each group is one scan of Spark's own
reader. Column types of all groups are joined in a lattice, so that the groups make one table. Values are read as text and cast
to the joined type; what the profile has seen of every row fits it.

A group is handed to the reader as folders, not as a list of its files: the highest folders whose files of that ending all
belong to the group. Where files of several groups share a folder, the folder is read for each of them and rows of the other
files fall to a semi-join on the path.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lakeprofile.functions import cells
from lakeprofile.functions.paths import ancestors, base_name, parent_path
from lakeprofile.functions.urls import percent_decode
from lakeprofile.lookups import READER_CHARSETS
from lakeprofile.plans.profile import profile_folder
from lakeprofile.session import literal_glob, qualify, write_and_read
from lakeprofile.sources import tables
from lakeprofile.sources.delimited import read_delimited
from lakeprofile.sources.inventory import list_location

FILE_PATH = "_file_path"
SPARK_FORMATS = ("parquet", "orc")
READABLE = ("csv", "json", "text", *SPARK_FORMATS)
# Endings of files that a table folder holds and no group may take.
TABLE_ENDINGS = (".parquet", ".json", ".orc", ".avro")
_CORRUPT = "__corrupt"
# Spark's readers know ISO-8859-1, which maps each byte to the character of its number; code page 1252 gives other characters
# to some of these.
_C1 = [byte for byte in range(0x80, 0xA0) if bytes([byte]).decode("cp1252", "ignore")]
_C1_LATIN, _C1_1252 = (bytes(_C1).decode(codec) for codec in ("latin-1", "cp1252"))
_WIDTHS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
_DIGITS = dict(zip(map(type, _WIDTHS), (3, 5, 10, 19)))


class Layout(NamedTuple):
    """What the reader of a group has to know."""

    file_type: str
    charset: str
    delimiter: str | None
    has_header: bool
    multi_line: bool
    names: tuple[str, ...]


# ---------------------------------------------------------------------------------------------------------------------
# The lattice of types
# ---------------------------------------------------------------------------------------------------------------------


def join_types(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds the values of both; text where there is no other.

    Integers widen to each other, to decimals and to doubles; structures are joined field by field, arrays by their elements;
    dates become timestamps.
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if type(a) in _DIGITS and type(b) in _DIGITS:
        return max(a, b, key=lambda kind: _DIGITS[type(kind)])
    decimals = [T.DecimalType(_DIGITS[type(kind)], 0) if type(kind) in _DIGITS else kind for kind in (a, b)]
    if all(isinstance(kind, T.DecimalType) for kind in decimals):
        scale = max(kind.scale for kind in decimals)
        whole = max(kind.precision - kind.scale for kind in decimals)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    if {type(a), type(b)} <= {T.DateType, T.TimestampType}:
        return T.TimestampType()
    if {type(a), type(b)} <= {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(join_types(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return join_schemas([a, b])
    return T.StringType()


def join_schemas(schemas: Iterable[T.StructType]) -> T.StructType:
    """All fields of the schemas, in the order first met, names told apart without regard to case."""
    fields: dict[str, T.StructField] = {}
    for schema in schemas:
        for field in schema.fields:
            known = fields.get(field.name.casefold())
            kind = join_types(known.dataType, field.dataType) if known else field.dataType
            fields[field.name.casefold()] = T.StructField(known.name if known else field.name, kind)
    return T.StructType(list(fields.values()))


def widened(value: Column, kind: T.DataType, wanted: T.DataType) -> Column:
    """A value of one type as a type that ``join_types`` made of it."""
    if kind == wanted:
        return value
    if isinstance(wanted, T.StructType) and isinstance(kind, T.StructType):
        own = {field.name.casefold(): field for field in kind.fields}
        parts = []
        for field in wanted.fields:
            mine = own.get(field.name.casefold())
            part = widened(value[mine.name], mine.dataType, field.dataType) if mine else F.lit(None).cast(field.dataType)
            parts.append(part.alias(field.name))
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(wanted, T.ArrayType) and isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: widened(item, kind.elementType, wanted.elementType))
    if isinstance(wanted, T.StringType) and isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    return value.try_cast(wanted)


# ---------------------------------------------------------------------------------------------------------------------
# The plan: groups of files and the folders that hold them
# ---------------------------------------------------------------------------------------------------------------------


def _readable() -> Column:
    return F.col("file_type").isin(*READABLE) & F.col("error").isNull() & ~base_name("path").rlike("^[_.]")


def planned_files(profiles: DataFrame) -> DataFrame:
    """``path, parent, ending, layout`` of every file that a profile names; ``layout`` is null for what isn't read."""
    charset = F.coalesce("encoding", F.lit("utf-8"))
    wide = charset.rlike("^utf-(16|32)")
    # Names tell layouts of delimited text and of self-describing files apart; JSON keys are read from any of them.
    names = F.when(F.col("file_type") == "csv", F.transform("columns", lambda c: c["name"])).when(
        F.col("file_type").isin(*SPARK_FORMATS), F.transform("columns", lambda c: F.concat(c["name"], F.lit(" "), c["detected_type"])))
    lines = F.col("json_format") == "ndjson"
    layout = F.struct(
        "file_type", F.when(charset == "ascii", "utf-8").otherwise(charset).alias("charset"), "delimiter",
        F.coalesce("has_header", F.lit(False)).alias("has_header"),
        F.when(F.col("file_type") == "csv", F.coalesce("quoted_breaks", F.lit(False)) | wide).when(F.col("file_type") == "json", ~lines | wide)
        .otherwise(F.lit(False)).alias("multi_line"),
        F.coalesce(names, F.array().cast("array<string>")).alias("names"))
    loose = profiles.filter(~F.col("file_type").isin("delta", "iceberg")).select(
        "path", parent_path("path").alias("parent"), F.regexp_extract(base_name("path"), r"(\.[^.]+)$", 1).alias("ending"),
        F.when(_readable(), layout).alias("layout"))
    inside = profiles.filter(F.col("file_type").isin("delta", "iceberg")).select(
        "path", F.col("path").alias("parent"), F.explode(F.array(*map(F.lit, TABLE_ENDINGS))).alias("ending"),
        F.lit(None).cast(loose.schema["layout"].dataType).alias("layout"))
    return loose.unionByName(inside)


def covering_folders(files: DataFrame, root: str) -> DataFrame:
    """``layout, ending, folder, pure``: the highest folders whose files of an ending have one layout only.

    A folder that holds several layouts itself is named for each of them, with ``pure`` false. Works on distinct folders,
    not on files.
    """
    key = F.coalesce(F.to_json("layout"), F.lit(""))
    direct = files.select("parent", "ending", "layout", key.alias("key")).groupBy("parent", "ending", "key").agg(F.any_value("layout").alias("layout"))
    above = direct.select("parent", "ending", "key", F.explode(F.array_append(ancestors("parent"), F.col("parent"))).alias("folder")).filter(
        (F.col("folder") == root) | F.col("folder").startswith(f"{root}/"))
    pure = above.groupBy("folder", "ending").agg((F.min("key") == F.max("key")).alias("pure")).filter("pure")
    highest = above.join(pure, ["folder", "ending"]).groupBy("parent", "ending", "key").agg(F.min_by("folder", F.length("folder")).alias("folder"))
    return (
        direct.filter(F.col("layout").isNotNull()).join(highest, ["parent", "ending", "key"], "left")
        .select("layout", "ending", F.coalesce("folder", "parent").alias("folder"), F.col("folder").isNotNull().alias("pure")).distinct()
    )


# ---------------------------------------------------------------------------------------------------------------------
# Readers
# ---------------------------------------------------------------------------------------------------------------------


def _reader_charset(charset: str) -> str:
    return "ISO-8859-1" if charset == "cp1252" else READER_CHARSETS.get(charset, charset).upper()


def _decoded(value: Column, charset: str) -> Column:
    return F.translate(value, _C1_LATIN, _C1_1252) if charset == "cp1252" else value


def _read_group(spark: SparkSession, layout: Layout, paths: list[str], keys: list[str], own: DataFrame | None, **options) -> DataFrame:
    """The rows of a group, values of text formats as text, with the path of their file; of files in ``own`` only, if given."""
    def _with_path(rows: DataFrame, **columns: Column) -> DataFrame:
        location = F.regexp_replace(percent_decode(F.col("_metadata.file_path")), "^file:/+", "/")
        found = rows.select(location.alias(FILE_PATH), *[column.alias(name) for name, column in columns.items()])
        return found if own is None else found.join(own, FILE_PATH, "left_semi")

    charset = _reader_charset(layout.charset)
    text = functools.partial(_decoded, charset=layout.charset)
    if layout.file_type == "csv":
        if len({name.casefold() for name in layout.names}) < len(layout.names):
            raise ValueError(f"Names that differ in case only can't be columns of one table: {', '.join(layout.names)}")
        # One column more than there are names: records that fill it are the ones a profile has skipped.
        schema = T.StructType([T.StructField(f"c{at}", T.StringType()) for at in range(len(layout.names) + 1)])
        rows = read_delimited(spark, paths, schema, layout.delimiter or ",", layout.has_header, charset, multiLine=layout.multi_line, **options)
        rows = rows.filter(F.col(f"c{len(layout.names)}").isNull())
        return _with_path(rows, **{name: text(cells.null_if_blank(F.col(f"c{at}"))) for at, name in enumerate(layout.names)})
    if layout.file_type == "json":
        if len({key.casefold() for key in keys}) < len(keys):
            raise ValueError(f"Keys that differ in case only can't be columns of one table: {', '.join(keys)}")
        schema = T.StructType([T.StructField(key, T.StringType()) for key in keys] + [T.StructField(_CORRUPT, T.StringType())])
        reader = spark.read.schema(schema).options(multiLine=layout.multi_line, columnNameOfCorruptRecord=_CORRUPT, encoding=charset, **options)
        rows = (reader if charset == "UTF-8" else reader.option("lineSep", "\n")).json(paths)
        # Lines that hold no object leave nothing but the corrupt column.
        return _with_path(rows.filter(F.col(_CORRUPT).isNull()), **{key: text(F.col(f"`{key}`")) for key in keys})
    if layout.file_type == "text":
        if charset.startswith(("UTF-16", "UTF-32")):
            # Line ends of wide characters aren't bytes that a splitter may look for: the file is one row until decoded.
            whole = _with_path(spark.read.format("binaryFile").options(**options).load(paths), content=F.col("content"))
            rows = whole.select(FILE_PATH, F.explode(F.split(F.regexp_replace(F.decode("content", charset), "\r?\n$", ""), "\r?\n")).alias("line"))
        else:
            # The text source keeps bytes as they are; only UTF-8 is what it takes them for.
            value = F.col("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), charset)
            rows = _with_path(spark.read.options(**options).text(paths), line=text(value))
        return rows.withColumn("line", F.regexp_replace(F.regexp_replace("line", "^\ufeff", ""), r"\s+$", ""))
    rows = spark.read.format(layout.file_type).options(**options).load(paths)
    return _with_path(rows, **{field.name: F.col(f"`{field.name}`") for field in rows.schema.fields})


def _scans(spark: SparkSession, layout: Layout, folders: list, files: DataFrame, keys: list[str]) -> DataFrame:
    """Pure folders are read whole; of a mixed one only the files of this layout stay.

    Columnar files can't be opened under another's schema: in a mixed folder they are read by name.
    """
    values = {name: F.array(*map(F.lit, value)).cast("array<string>") if isinstance(value, tuple) else F.lit(value)
              for name, value in layout._asdict().items()}
    same = F.to_json("layout") == F.to_json(F.struct(*[value.alias(name) for name, value in values.items()]))
    parts = []
    for ending in sorted({row.ending for row in folders}):
        pure = [row.folder for row in folders if row.ending == ending and row.pure]
        mixed = [row.folder for row in folders if row.ending == ending and not row.pure]
        if pure:
            parts.append(_read_group(spark, layout, list(map(literal_glob, pure)), keys, None, recursiveFileLookup=True, pathGlobFilter=f"*{literal_glob(ending)}"))
        if mixed and layout.file_type in SPARK_FORMATS:
            named = files.filter(same & (F.col("ending") == ending) & F.col("parent").isin(mixed)).select("path").collect()
            parts.append(_read_group(spark, layout, [literal_glob(row.path) for row in named], keys, None))
        elif mixed:
            parts.append(_read_group(spark, layout, [f"{literal_glob(folder)}/*{literal_glob(ending)}" for folder in mixed], keys,
                                     files.filter(same).select(F.col("path").alias(FILE_PATH))))
    return functools.reduce(DataFrame.unionByName, parts)


def read_profiled(spark: SparkSession, root: str, profiles: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Rows of all readable files and Delta tables that ``profiles`` (of the location ``root``) names, as one typed table.

    Columns are the union of all files' columns, with the types that hold what every file has, or the ones ``types`` gives;
    ``_file_path`` names a row's file or table. Lines of text files stand in ``line``. Nested JSON values are JSON text.
    Left out, as in the profile: records with too many fields, lines that are no JSON, files with an error. Also left
    out: workbooks, Iceberg tables, and names that begin with ``_`` or ``.``, which Spark's readers skip (see ``unread``).
    What passes the driver are layouts, folders and column names, not files.
    """
    root = qualify(spark, root).rstrip("/")
    profiles = write_and_read(profiles.select("path", "file_type", "encoding", "delimiter", "has_header", "quoted_breaks", "json_format", "columns", "error"),
                              "reading-profiles")
    files = planned_files(profiles)
    one_file = files.filter((F.col("path") == root) & F.col("layout").isNotNull()).select("layout").first()
    covers = [] if one_file else covering_folders(files, root).collect()
    by_layout: dict[Layout, list] = {}
    for row in [one_file] if one_file else covers:
        layout = Layout(**{**row.layout.asDict(), "names": tuple(row.layout.names)})
        by_layout.setdefault(layout, []).append(row)
    about = profiles.filter(_readable() & F.col("file_type").isin("csv", "json")).select("file_type", F.inline("columns"))
    # A column without any value in a file says nothing of its type.
    kind = F.when(F.col("sample_value").isNotNull(), F.col("spark_type")).otherwise("void").alias("kind")
    seen = about.groupBy("file_type", "name", kind).agg(F.min("ordinal").alias("ordinal")).collect()
    told = [T.StructType([T.StructField(row["name"], T._parse_datatype_string(row.kind))])
            for row in sorted(seen, key=lambda row: (row.file_type, row.ordinal, row["name"]))]
    keys = list(dict.fromkeys(row["name"] for row in sorted(seen, key=lambda row: (row.ordinal, row["name"])) if row.file_type == "json"))

    scans = [
        (layout, _read_group(spark, layout, [literal_glob(root)], keys, None) if one_file else _scans(spark, layout, folders, files, keys))
        for layout, folders in sorted(by_layout.items(), key=lambda item: str(item[0]))
    ]
    for row in profiles.filter("file_type = 'delta' AND error IS NULL AND columns IS NOT NULL").select("path").collect():  # one row a table
        table_files = list_location(spark, row.path).filter("kind = 'file'")
        rows = tables.read_delta(spark, row.path, table_files)
        scans.append((None, rows.select(F.lit(row.path).alias(FILE_PATH), *[F.col(f"`{name}`") for name in rows.columns])))
    if not scans:
        return spark.createDataFrame([], T.StructType([T.StructField(FILE_PATH, T.StringType())]))

    declared = [T.StructType([field for field in rows.schema.fields if field.name != FILE_PATH]) for layout, rows in scans
                if layout is None or layout.file_type in (*SPARK_FORMATS, "text")]
    merged = T.StructType([T.StructField(field.name, T.StringType() if isinstance(field.dataType, T.NullType) else field.dataType)
                           for field in join_schemas([*told, *declared]).fields])
    asked = {name.casefold(): T._parse_datatype_string(kind) for name, kind in (types or {}).items()}
    parts = []
    for _, rows in scans:
        own = {field.name.casefold(): field for field in rows.schema.fields}
        columns = []
        for field in merged.fields:
            wanted = asked.get(field.name.casefold(), field.dataType)
            mine = own.get(field.name.casefold())
            value = widened(F.col(f"`{mine.name}`"), mine.dataType, wanted) if mine else F.lit(None).cast(wanted)
            columns.append(value.alias(field.name))
        parts.append(rows.select(FILE_PATH, *columns))
    return functools.reduce(DataFrame.unionByName, parts)


def read_location(spark: SparkSession, location: str, types: dict[str, str] | None = None) -> DataFrame:
    """Profiles a location and reads it (``read_profiled``)."""
    return read_profiled(spark, location, profile_folder(spark, location), types)


def unread(profiles: DataFrame) -> DataFrame:
    """``path, reason`` of what ``read_profiled`` leaves out."""
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.col("file_type").isin(*READABLE, "delta"), F.concat(F.lit("no reader for "), "file_type"))
        .when(F.col("file_type").isin(*READABLE) & base_name("path").rlike("^[_.]"), "hidden name")
    )
    return profiles.select("path", reason.alias("reason")).filter("reason IS NOT NULL")
