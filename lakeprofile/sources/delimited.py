"""Delimited text: dialect and sample per file, folder reads with one dialect."""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lakeprofile.functions import cells
from lakeprofile.functions.sqltypes import sized_length
from lakeprofile.functions.urls import percent_decode
from lakeprofile.lookups import CSV_SAMPLE_ROWS, DIALECT_SAMPLE_CHARS, READER_CHARSETS
from lakeprofile.session import literal_glob, spread
from lakeprofile.sources.storage import Storage

SAMPLES = (
    "path string, delimiter string, has_header boolean, raw_names array<string>, names array<string>, "
    "rows array<array<string>>, bad_lines bigint, sample_error string"
)
COLUMNS = (
    "array<struct<ordinal:int,name:string,detected_type:string,spark_type:string,nullable:boolean,nesting:string,"
    "observed_max_len:bigint,sized_len:bigint,sample_value:string>>"
)


# Delimiters to try, in order of preference, and the share of lines that must agree on one.
DELIMITERS = [",", ";", "\t", "|", ":"]
AGREEMENT = 0.8
NUMBER_LIKE = re.compile(r"[+-]?(\d+([.,]\d+)?|\.\d+)([eE][+-]?\d+)?|\d{4}-\d{2}-\d{2}.*")
HEAD_ROWS = 100
LONGEST_NAME = 64


def open_text(storage: Storage, path: str, encoding: str | None) -> io.TextIOWrapper:
    codec = "utf-8" if encoding in (None, "ascii", "binary") else encoding
    return io.TextIOWrapper(io.BufferedReader(storage.open(path)), encoding=codec, errors="replace", newline="")


def _fields(line: str, delimiter: str) -> int:
    """Fields of a line, delimiters between quotes apart."""
    return sum(part.count(delimiter) for part in line.split('"')[::2]) + 1


def _looks_typed(cell: str) -> bool:
    cell = cell.strip().strip('"')
    return bool(NUMBER_LIKE.fullmatch(cell))


def dialect_of(lines: list[str]) -> tuple[str | None, bool]:
    """(delimiter, has header) that most lines agree on; no delimiter where none splits them alike.

    For each candidate the field count most lines have is taken; the candidate whose count holds for most lines wins, then
    the one with more fields. A header is a first record of names above values: no cell of it is a number or empty, and
    it's either followed by numbers in some column or by lines that don't repeat it.
    """
    lines = [line for line in lines if line.strip()]
    if not lines:
        return None, True
    csv.field_size_limit(2**31 - 1)
    best = None
    for rank, delimiter in enumerate(DELIMITERS):
        counts = Counter(_fields(line, delimiter) for line in lines)
        fields, agreeing = max(counts.items(), key=lambda item: (item[1] if item[0] > 1 else 0, item[0]))
        if fields > 1 and agreeing / len(lines) >= AGREEMENT:
            best = max(best or (0.0, 0, 0, ""), (agreeing / len(lines), fields, -rank, delimiter))
    delimiter = best[3] if best else None
    return delimiter, has_names(list(csv.reader(io.StringIO("\n".join(lines), newline=""), delimiter=delimiter or ",")) or [[]])


def has_names(rows: list[list[str]]) -> bool:
    """Whether the first of some records holds names: no cell of it is a number or empty, nor repeated above values of text."""
    first, rest = rows[0], [row for row in rows[1:] if len(row) == len(rows[0])]
    if any(not cell.strip() or _looks_typed(cell) for cell in first):
        return False
    return len(set(first)) == len(first) or any(_looks_typed(cell) for row in rest for cell in row)


def sniff_dialect(sample: str, path: str) -> tuple[str, bool]:
    """(delimiter, has header) of a prefix; the delimiter the name suggests where the text gives no clue."""
    delimiter, has_header = dialect_of(_whole_lines(sample))
    return delimiter or ("\t" if ".tsv" in path.lower() else ","), has_header


def delimited_lines(sample: str) -> bool:
    """Whether the lines of a prefix are a header and records rather than prose, which has no blank-free first line of names."""
    lines = _whole_lines(sample)
    delimiter, has_header = dialect_of(lines)
    if delimiter in (None, ":") or not has_header or len(lines) < 2:
        return False
    names = next(csv.reader(io.StringIO(lines[0], newline=""), delimiter=delimiter))
    return all(0 < len(name.strip()) <= LONGEST_NAME and name.strip().count(" ") <= 2 and not name.rstrip().endswith(".") for name in names)


def _whole_lines(sample: str) -> list[str]:
    """Records of a prefix; the last one may be cut off and is left out, lines inside quotes are one record."""
    lines, record = [], ""
    parts = sample.split("\n")
    for line in parts[:-1] if len(parts) > 2 else parts:
        record = f"{record}\n{line}" if record else line
        if record.count('"') % 2 == 0:
            lines.append(record)
            record = ""
    return lines or [sample]


def distinct_names(header: list[str]) -> list[str]:
    """Header names made usable: blanks numbered, repeats suffixed."""
    seen: dict[str, int] = {}
    names = []
    for position, name in enumerate(header):
        name = name or f"Unnamed: {position}"
        repeats = seen.get(name, 0)
        seen[name] = repeats + 1
        names.append(f"{name}.{repeats}" if repeats else name)
    return names


def read_sample(storage: Storage, path: str, encoding: str | None, limit: int, told: str | None = None) -> tuple:
    """Dialect and first records of a file. ``told`` is the delimiter all its records agree on, where that is known."""
    csv.field_size_limit(2**31 - 1)
    with open_text(storage, path, encoding) as text:
        if told:
            # Whole records however long they are, not a number of characters.
            records = (record for record in csv.reader(text, delimiter=told) if record)
            delimiter, has_header = told, has_names(list(islice(records, HEAD_ROWS)) or [[]])
        else:
            head = text.read(DIALECT_SAMPLE_CHARS)
            delimiter, has_header = sniff_dialect(head.replace("\r\n", "\n").replace("\r", "\n"), path)
    raw_names, names, rows, bad = None, None, [], 0
    with open_text(storage, path, encoding) as text:
        for record in csv.reader(text, delimiter=delimiter):
            if not record:
                continue
            if names is None:
                raw_names = record if has_header else None
                names = distinct_names(record) if has_header else [f"column_{n + 1}" for n in range(len(record))]
                if has_header:
                    continue
            if len(record) > len(names):
                bad += 1
                continue
            rows.append(record + [None] * (len(names) - len(record)))
            if len(rows) >= limit:
                break
    if names is None:
        return path, delimiter, has_header, None, None, None, 0, "no columns to parse from file"
    return path, delimiter, has_header, raw_names, names, rows, bad, None


def csv_samples(files: DataFrame, limit: int = CSV_SAMPLE_ROWS) -> DataFrame:
    """Dialect and first records of each file (``path``, ``encoding``, and ``told`` where the delimiter is known); bad files give an error row."""
    names = [field.strip().split()[0] for field in SAMPLES.split(", ")]

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        storage = Storage()
        for batch in batches:
            for path, encoding, told in batch[["path", "encoding", "told"]].itertuples(index=False):
                try:
                    row = read_sample(storage, path, encoding, limit, told)
                except Exception as problem:
                    row = (path, ",", False, None, None, None, 0, str(problem))
                yield pd.DataFrame([row], columns=names)

    told = F.col("told") if "told" in files.columns else F.lit(None).cast("string").alias("told")
    return spread(files.select("path", "encoding", told), "path").mapInPandas(sample, SAMPLES)


def sampled_columns(names: Column, rows: Column, null_words: list[str] | None = None) -> Column:
    """Column profiles of a sample held in one row: types, widths, first value. No shuffle."""

    def describe(name: Column, position: Column) -> Column:
        values = F.transform(rows, lambda row: cells.null_if_blank(F.get(row, position), null_words))
        present = F.filter(values, lambda value: value.isNotNull())
        classes = F.transform(present, cells.cell_class)
        detected = F.when(F.size(rows) == 0, "object").otherwise(cells.column_type(
            F.array_min(classes), F.array_max(classes), F.size(present) < F.size(values)
        ))
        width = F.coalesce(F.array_max(F.transform(present, F.length)), F.lit(0)).cast("bigint")
        observed = F.when(detected == "object", width)
        return F.struct(
            (position + 1).alias("ordinal"), name.alias("name"), detected.alias("detected_type"),
            F.lit(None).cast("string").alias("spark_type"), F.lit(True).alias("nullable"),
            F.lit("scalar").alias("nesting"), observed.alias("observed_max_len"),
            sized_length(observed).alias("sized_len"), F.get(present, F.lit(0)).alias("sample_value"),
        )

    return F.transform(names, describe).cast(COLUMNS)


def whole_columns(files: DataFrame) -> DataFrame:
    """Column profiles over every record: ``path, columns, examined, too_long``.

    Files come with ``path, encoding, delimiter, has_header, quoted_breaks, names, rows`` (first rows, for the sample value).
    Files of one dialect and width are read together by Spark's reader, split into ranges unless a quoted field holds a line
    break or the encoding is wide; per file one row of partial minima, maxima and counts is shuffled. Records with too many
    fields are counted and left out. The paths of a dialect pass the driver, where Spark's own file index holds them too.
    """
    spark = files.sparkSession
    known = files.select("path", "encoding", "delimiter", "has_header", F.coalesce("quoted_breaks", F.lit(False)).alias("quoted_breaks"),
                         F.size("names").alias("width"))
    dialects = known.groupBy("encoding", "delimiter", "has_header", "quoted_breaks", "width").agg(F.collect_list("path").alias("paths"))
    parts = []
    for d in dialects.toLocalIterator():
        # Types and widths are the same in both of the single-byte pages; Spark's reader takes one of them.
        charset = "ISO-8859-1" if d.encoding == "cp1252" else READER_CHARSETS.get(d.encoding, d.encoding or "UTF-8")
        wide = charset.lower().startswith(("utf-16", "utf-32"))
        # One column more than there are names: what is in it is too much.
        schema = T.StructType([T.StructField(f"c{at}", T.StringType()) for at in range(d.width + 1)])
        rows = read_delimited(spark, list(map(literal_glob, d.paths)), schema, d.delimiter, d.has_header, charset, multiLine=bool(d.quoted_breaks or wide),
                              ignoreMissingFiles=True, enforceSchema=True)
        location = F.regexp_replace(percent_decode(F.col("_metadata.file_path")), "^file:/+", "/")
        cells_ = [cells.null_if_blank(F.col(f"c{at}")).alias(f"c{at}") for at in range(d.width + 1)]
        rows = rows.select(location.alias("path"), *cells_)
        usual = rows.filter(F.col(f"c{d.width}").isNull())
        about = []
        for at in range(d.width):
            class_ = cells.cell_class(F.col(f"c{at}"))
            about += [F.min(class_).alias(f"low{at}"), F.max(class_).alias(f"high{at}"), F.count(f"c{at}").alias(f"present{at}"),
                      F.max(F.length(f"c{at}")).cast("bigint").alias(f"longest{at}"), F.first(f"c{at}", True).alias(f"some{at}")]
        measured = usual.groupBy("path").agg(F.count("*").alias("examined"), *about)
        entries = F.array(*[
            F.struct(F.col(f"low{at}").alias("low"), F.col(f"high{at}").alias("high"), F.col(f"present{at}").alias("present"),
                     F.col(f"longest{at}").alias("longest"), F.col(f"some{at}").alias("some")) for at in range(d.width)])
        too_long = rows.filter(F.col(f"c{d.width}").isNotNull()).groupBy("path").agg(F.count("*").alias("too_long"))
        parts.append(measured.select("path", "examined", entries.alias("about")).join(too_long, "path", "left"))
    empty = spark.createDataFrame([], "path string, examined bigint, about array<struct<low:int,high:int,present:bigint,longest:bigint,some:string>>, too_long bigint")
    measured = empty
    for part in parts:
        measured = measured.unionByName(part)

    examined = F.coalesce("examined", F.lit(0))

    def describe(name: Column, position: Column) -> Column:
        found = F.get("about", position)
        detected = F.when(examined == 0, "object").otherwise(
            cells.column_type(found["low"], found["high"], F.coalesce(found["present"], F.lit(0)) < examined))
        observed = F.when(detected == "object", F.coalesce(found["longest"], F.lit(0)))
        values = F.filter(F.transform("rows", lambda row: cells.null_if_blank(F.get(row, position))), lambda value: value.isNotNull())
        return F.struct(
            (position + 1).alias("ordinal"), name.alias("name"), detected.alias("detected_type"),
            F.lit(None).cast("string").alias("spark_type"), F.lit(True).alias("nullable"), F.lit("scalar").alias("nesting"),
            observed.alias("observed_max_len"), sized_length(observed).alias("sized_len"),
            F.coalesce(F.get(values, F.lit(0)), found["some"]).alias("sample_value"))

    return files.select("path", "names", "rows").join(measured, "path", "left").select(
        "path", F.transform("names", describe).cast(COLUMNS).alias("columns"), examined.alias("examined"),
        F.coalesce("too_long", F.lit(0)).alias("too_long"))


def read_delimited(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, delimiter: str = ",",
                   has_header: bool = True, encoding: str = "UTF-8", **options) -> DataFrame:
    """A folder or file of one dialect, read in parallel by byte ranges.

    Without a schema every column is text: one look at a header, no inference pass over the data. Quoted line breaks
    need ``multiLine=True``.
    """
    reader = spark.read.options(sep=delimiter, header=has_header, encoding=encoding, quote='"', escape='"', **options)
    if schema is not None:
        return reader.schema(schema).csv(path)
    df = reader.csv(path)
    return df if has_header else df.toDF(*[f"column_{n + 1}" for n in range(len(df.columns))])


REJECTED = "_rejected"


def read_with_rejects(spark: SparkSession, path: str, schema: T.StructType, **dialect) -> DataFrame:
    """Typed rows plus ``_rejected``: the raw line of a row that does not fit the schema, else null."""
    full = T.StructType([*schema.fields, T.StructField(REJECTED, T.StringType())])
    rows = read_delimited(spark, path, full, mode="PERMISSIVE", columnNameOfCorruptRecord=REJECTED, **dialect)
    # Spark checks only the fields a query uses. The comparison always holds; it makes every field count.
    smallest = F.lit(-(2**63))
    all_fields = F.xxhash64(*[F.col(f"`{name}`") for name in schema.names])
    return rows.withColumn(REJECTED, F.when(all_fields >= smallest, F.col(REJECTED)))


def row_estimate(files: DataFrame, lines: int) -> DataFrame:
    """Estimated rows per file from the mean size of its first lines (``path``, ``size``, ``has_header``)."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        storage = Storage()
        for batch in batches:
            measured = []
            for path in batch["path"]:
                with io.BufferedReader(storage.open(path)) as handle:
                    sizes = [len(line) for _, line in zip(range(lines), handle)]
                measured.append((path, sum(sizes), len(sizes)))
            yield pd.DataFrame(measured, columns=["path", "sample_bytes", "sample_lines"])

    head = spread(files.select("path", "size", "has_header"), "path")
    sizes = head.mapInPandas(measure, "path string, sample_bytes bigint, sample_lines bigint")
    mean = F.greatest(F.col("sample_bytes") / F.greatest("sample_lines", F.lit(1)), F.lit(1.0))
    estimate = F.floor(F.col("size") / mean) - F.when(F.col("has_header"), 1).otherwise(0)
    return files.select("path", "size", "has_header").join(sizes, "path").select(
        "path", F.greatest(estimate, F.lit(0)).cast("bigint").alias("row_estimate")
    )
