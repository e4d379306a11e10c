"""First sheet of .xlsx workbooks, read with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lakeprofile.functions.sqltypes import sized_length
from lakeprofile.lookups import WORKBOOK_SAMPLE_ROWS
from lakeprofile.session import spread
from lakeprofile.sources.delimited import COLUMNS, distinct_names
from lakeprofile.sources.storage import Storage

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show dates or times (fixed values).
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
CELLS = "path string, row bigint, col bigint, kind string, value string"
SHEET = "path string, names array<string>, rows array<array<string>>, kinds array<array<string>>, error string"


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]*", reference).group():
        number = number * 26 + ord(letter) - 64
    return number


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.parse(book.open("xl/sharedStrings.xml")).getroot()
    return ["".join(text.text or "" for text in item.iter(f"{MAIN}t")) for item in root.iter(f"{MAIN}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.parse(book.open("xl/styles.xml")).getroot()
    dates = set(DATE_FORMATS)
    for custom in root.iter(f"{MAIN}numFmt"):
        bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get("formatCode", ""))
        if re.search("[ymdhs]", bare, re.IGNORECASE):
            dates.add(int(custom.get("numFmtId")))
    formats = root.find(f"{MAIN}cellXfs")
    if formats is None:
        return set()
    return {index for index, style in enumerate(formats) if int(style.get("numFmtId", 0)) in dates}


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = next(ElementTree.parse(book.open("xl/workbook.xml")).getroot().iter(f"{MAIN}sheet"))
    relations = ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()
    target = next(item.get("Target") for item in relations if item.get("Id") == sheet.get(RELATION))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _cell(cell, strings: list[str], dates: set[int]) -> tuple[str, str | None]:
    """(kind, text): n number, s string, b boolean, d date, e error."""
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "s", "".join(text.text or "" for text in cell.iter(f"{MAIN}t"))
    value = cell.findtext(f"{MAIN}v")
    if value is None:
        return kind, None
    if kind == "s":
        return "s", strings[int(value)]
    if kind == "b":
        return "b", "true" if value == "1" else "false"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        moment = pd.Timestamp("1899-12-30") + pd.to_timedelta(round(float(value) * 86400), unit="s")
        return "d", moment.strftime("%Y-%m-%d %H:%M:%S")
    return {"str": "s", "d": "d", "e": "e"}.get(kind, "n"), value


def sheet_cells(content) -> Iterator[tuple[int, int, str, str]]:
    """(row, column, kind, text) of the first sheet, streamed."""
    with zipfile.ZipFile(content) as book:
        strings, dates = _shared_strings(book), _date_styles(book)
        row = 0
        for _, element in ElementTree.iterparse(book.open(_first_sheet(book))):
            if element.tag != f"{MAIN}row":
                continue
            row = int(element.get("r", row + 1))
            column = 0
            for cell in element.iter(f"{MAIN}c"):
                column = _column_number(cell.get("r", "")) or column + 1
                kind, value = _cell(cell, strings, dates)
                if value is not None:
                    yield row, column, kind, value
            element.clear()


def workbook_cells(files: DataFrame) -> DataFrame:
    """Every filled cell of the first sheet of each workbook."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        storage = Storage()
        for batch in batches:
            for path in batch["path"]:
                cells = []
                with io.BufferedReader(storage.open(path)) as handle:
                    for cell in sheet_cells(handle):
                        cells.append((path, *cell))
                        if len(cells) == 10_000:
                            yield pd.DataFrame(cells, columns=["path", "row", "col", "kind", "value"])
                            cells = []
                yield pd.DataFrame(cells, columns=["path", "row", "col", "kind", "value"])

    return spread(files.select("path"), "path").mapInPandas(read, CELLS)


def workbook_contents(files: DataFrame) -> DataFrame:
    """What all rows below the header of each first sheet hold.

    ``row_count`` and ``width`` of the sheet, ``stats`` by column number, and ``cells_error`` of a sheet that can't be read
    to its end. Cells are streamed; per file and column one row of counts, minima and maxima is shuffled.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "below", "col", "kind", "value", "cells_error"]
        storage = Storage()
        for batch in batches:
            for path in batch["path"]:
                cells, first = [], None
                try:
                    with io.BufferedReader(storage.open(path)) as handle:
                        for row, column, kind, value in sheet_cells(handle):
                            first = row if first is None else first
                            cells.append((path, row - first, column, kind, value, None))
                            if len(cells) == 10_000:
                                yield pd.DataFrame(cells, columns=names)
                                cells = []
                except Exception as problem:
                    cells.append((path, 0, 0, None, None, str(problem)))
                yield pd.DataFrame(cells, columns=names)

    cells = spread(files.select("path"), "path").mapInPandas(
        read, "path string, below bigint, col bigint, kind string, value string, cells_error string")
    body = F.col("below") > 0
    of_column = cells.groupBy("path", "col").agg(
        F.max("below").alias("last"),
        F.count_if(body).alias("present"),
        F.min(F.when(body, F.col("kind"))).alias("least_kind"),
        F.max(F.when(body, F.col("kind"))).alias("kind"),
        F.min(F.when(body, F.col("value").rlike(r"^-?\d+(\.0+)?$"))).alias("whole"),
        F.max(F.when(body, F.length("value"))).cast("bigint").alias("longest"),
        F.min_by("value", F.when(body, F.col("below"))).alias("sample_value"),
        F.max("cells_error").alias("cells_error"),
    )
    return of_column.groupBy("path").agg(
        F.greatest(F.max("last"), F.lit(0)).alias("row_count"),
        F.max(F.when((F.col("present") > 0) | (F.col("last") == 0), F.col("col"))).cast("int").alias("width"),
        F.map_from_entries(F.collect_list(F.struct("col", F.struct(
            "present", "least_kind", "kind", "whole", "longest", "sample_value")))).alias("stats"),
        F.max("cells_error").alias("cells_error"),
    )


def all_names(names: Column, width: Column) -> Column:
    """The names of a sample's columns and of those that only later rows have."""
    def run(names, width):
        if names is None:
            return None
        return names + distinct_names(names + [""] * ((width or 0) - len(names)))[len(names):]

    return F.udf(run, "array<string>")(names, width)


def _sample(handle, limit: int) -> tuple[list, list, list]:
    header: dict[int, str] = {}
    rows: dict[int, dict[int, tuple]] = {}
    first = None
    for row, column, kind, value in sheet_cells(handle):
        first = row if first is None else first
        if row == first:
            header[column] = value
        elif row - first <= limit:
            rows.setdefault(row, {})[column] = (kind, value)
        else:
            break
    width = max([*header, *[column for cells in rows.values() for column in cells]], default=0)
    columns = range(1, width + 1)
    # A gap between filled rows is an empty row.
    span = range(first + 1, max(rows) + 1) if rows else ()
    picked = [rows.get(number, {}) for number in span]
    return (
        distinct_names([header.get(column, "") for column in columns]),
        [[cells.get(column, (None, None))[1] for column in columns] for cells in picked],
        [[cells.get(column, (None, None))[0] for column in columns] for cells in picked],
    )


def workbook_samples(files: DataFrame, limit: int = WORKBOOK_SAMPLE_ROWS) -> DataFrame:
    """Header and first rows of each workbook; the old binary format gives an error row."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        storage = Storage()
        for batch in batches:
            for path in batch["path"]:
                try:
                    if path.lower().endswith(".xls"):
                        raise ValueError("binary .xls workbooks are not supported")
                    with io.BufferedReader(storage.open(path)) as handle:
                        row = (path, *_sample(handle, limit), None)
                except Exception as problem:
                    row = (path, None, None, None, str(problem))
                yield pd.DataFrame([row], columns=["path", "names", "rows", "kinds", "error"])

    return spread(files.select("path"), "path").mapInPandas(read, SHEET)


def workbook_columns(names: Column, row_count: Column, stats: Column) -> Column:
    """Column profiles of a sheet from its ``workbook_contents``; types come from the cells' own kinds."""

    def describe(name: Column, position: Column) -> Column:
        found = F.try_element_at(stats, (position + 1).cast("bigint"))
        present = F.coalesce(found["present"], F.lit(0))
        only = lambda kind: (found["kind"] == kind) & (found["least_kind"] == kind)
        gaps = present < row_count
        detected = (
            F.when(row_count == 0, "object")
            .when(present == 0, "float64")
            .when(only("n") & found["whole"] & ~gaps, "int64")
            .when(only("n"), "float64")
            .when(only("b") & ~gaps, "bool")
            .when(only("d"), "datetime64[ns]")
            .otherwise("object")
        )
        observed = F.when(detected == "object", found["longest"])
        return F.struct(
            (position + 1).alias("ordinal"), name.alias("name"), detected.alias("detected_type"),
            F.lit(None).cast("string").alias("spark_type"), F.lit(True).alias("nullable"),
            F.lit("scalar").alias("nesting"), observed.alias("observed_max_len"),
            sized_length(observed).alias("sized_len"), F.when(present > 0, found["sample_value"]).alias("sample_value"),
        )

    return F.transform(names, describe).cast(COLUMNS)
