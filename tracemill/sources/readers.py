"""Scans: tables of cells from CSV files and workbooks, sections from XML, lists from JSON, raw files."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.scalars import strip

_ROWS = "file string, sheet string, row_number int, cells array<string>"
_ROW_NAMES, _ROW_TYPES = ["file", "sheet", "row_number", "cells"], [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())]
#: Rows of cells that a task hands on at once.
ROWS_AT_ONCE = 5_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _cells(files: DataFrame, read: Callable[[str, bytes], Iterable[tuple[str, int, list]]]) -> DataFrame:
    """Rows of files (path, content) as `read` gives them (sheet, row_number, cells), in one pass; small files share a batch, a large one makes several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [], [], [], []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _ROW_TYPES, strict=True)], names=_ROW_NAMES)
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                name = name.as_py()
                for row in read(name, content.as_py()):
                    for column, value in zip(out, (name, *row), strict=True):
                        column.append(value)
                    if len(out[0]) >= ROWS_AT_ONCE:
                        yield made()
                        out = [], [], [], []
        if out[0]:
            yield made()

    return files.select("path", "content").mapInArrow(run, _ROWS)


def csv_rows(content: bytes) -> Iterator[tuple[str, int, list]]:
    rows = csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline=""))
    for k, row in enumerate(rows, 1):
        yield "csv", k, [c or None for c in row]


def csv_cells(files: DataFrame) -> DataFrame:
    """(file, sheet, row_number, cells) of CSV files (path, content): every row in file order, header or not; a byte-order mark goes.

    A file is one record, as row order matters and quotes may hold line ends; many files make many tasks.
    """

    return _cells(files, lambda name, content: csv_rows(content))


def read_csv_cells(spark: SparkSession, path: str) -> DataFrame:
    return csv_cells(raw_files(spark, path))


@cache
def _place(letters: str) -> int:
    n = 0
    for letter in letters:
        n = 26 * n + ord(letter) - 64
    return n


def _column(ref: str) -> int:
    return _place(ref.rstrip("0123456789"))


_COL, _ROW, _CELL, _VALUE, _FORMULA, _TEXT, _MERGE = (_MAIN + t for t in ("col", "row", "c", "v", "f", "t", "mergeCell"))


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, list]]:
    """(sheet, row, cells) of an .xlsx file: visible rows and columns, merged cells filled, formulas without a value as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(_TEXT)) for item in root.iter(f"{_MAIN}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = links[sheet.get(_REL)].lstrip("/")
            root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
            hidden = {k for c in root.iter(_COL) if c.get("hidden") in ("1", "true") for k in range(int(c.get("min")), int(c.get("max")) + 1)}
            grid: dict[int, dict[int, str]] = {}
            unseen, last = set(), 0
            for row in root.iter(_ROW):
                at = int(row.get("r"))
                if row.get("hidden") in ("1", "true"):
                    unseen.add(at)
                cells = grid.get(at, {})
                for cell in row.iter(_CELL):
                    kind = cell.get("t")
                    if kind == "inlineStr":
                        text = "".join([t.text or "" for t in cell.iter(_TEXT)])
                    elif (value := cell.find(_VALUE)) is not None and value.text is not None:
                        text = shared[int(value.text)] if kind == "s" else value.text
                    elif (formula := cell.find(_FORMULA)) is not None:
                        text = f"={formula.text or ''}"
                    else:
                        continue
                    cells[_column(cell.get("r"))] = text
                if cells:
                    grid[at] = cells
                    last = max(last, *cells)
            for merge in root.iter(_MERGE):
                a, b = merge.get("ref").split(":")
                first = grid.get(int(re.sub(r"\D", "", a)), {}).get(_column(a))
                if first is not None:
                    last = max(last, _column(b))
                    for at in range(int(re.sub(r"\D", "", a)), int(re.sub(r"\D", "", b)) + 1):
                        for k in range(_column(a), _column(b) + 1):
                            grid.setdefault(at, {})[k] = first
            shown = [k for k in range(1, last + 1) if k not in hidden]
            for at in sorted(grid.keys() - unseen):
                cells = grid[at]
                yield sheet.get("name"), at, [cells.get(k) for k in shown]


def workbook_cells(files: DataFrame) -> DataFrame:
    """(file, sheet, row_number, cells) of .xlsx files (path, content), one task record a file. Row numbers are the sheet's own."""

    return _cells(files, lambda name, content: workbook_rows(content))


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    return workbook_cells(raw_files(spark, path))


def sheet_text(rows: DataFrame, gap: str = " | ") -> DataFrame:
    """(file, sheet, row_number, text) of rows of cells: the filled cells, joined; rows without any go."""
    filled = F.filter(F.transform("cells", strip), lambda c: c != "")
    return rows.select("file", "sheet", "row_number", F.array_join(filled, gap).alias("text")).filter("text <> ''")


def evidence_cells(files: DataFrame) -> DataFrame:
    """Rows of cells of files (path, content) of any mix of suffixes: .csv, .xlsx and .xlsm; another suffix is an error in the row's task."""

    def read(name: str, content: bytes) -> Iterable[tuple[str, int, list]]:
        suffix = name.rsplit(".", 1)[-1].lower()
        if suffix == "csv":
            return csv_rows(content)
        if suffix in ("xlsx", "xlsm"):
            return workbook_rows(content)
        raise ValueError(f"unsupported evidence file: {name}")

    return _cells(files, read)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: .csv, .xlsx or .xlsm; anything else is an error."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return read_csv_cells(spark, path)
    if suffix in ("xlsx", "xlsm"):
        return read_workbooks(spark, path)
    raise ValueError(f"unsupported evidence file: {path}")


_SECTION = "_N string, _TYPE string, HEAD string, P array<string>"


def read_xml_sections(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """(section, heading, text) of regulation XML: DIV8 elements of type SECTION whose number 1.N lies in low..high."""
    return xml_sections(spark.read.format("xml").option("rowTag", "DIV8").schema(_SECTION).load(path), low, high)


def xml_sections(rows: DataFrame, low: int, high: int) -> DataFrame:
    """As read_xml_sections, of DIV8 elements that are parsed already."""
    number = F.try_to_number(F.regexp_extract("_N", r"1\.(\d{4})", 1), F.lit("9999")).cast("int")
    kept = rows.filter((F.col("_TYPE") == "SECTION") & number.between(low, high))
    return kept.select(F.concat(F.lit("1."), number.cast("string")).alias("section"), F.col("HEAD").alias("heading"), F.concat_ws("\n", "P").alias("text"))


def read_json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lists; files that are missing make an empty table."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except Exception as error:  # Spark names a missing path so
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def read_registry(spark: SparkSession, folder: str, schema: str, source: str = "sourceId") -> DataFrame:
    """(source_dir, file, and the schema's columns) of every <source>/normalized/*.json list below a folder, in one scan; a source named in the path stands in for a missing one."""
    path = F.col("_metadata.file_path")
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*/normalized/*.json")
    rows = rows.select(F.regexp_extract(path, r"([^/]+)/normalized/[^/]+$", 1).alias("source_dir"), F.regexp_extract(path, r"([^/]+)$", 1).alias("file"), *rows.columns)
    return rows.withColumn(source, F.coalesce(source, "source_dir"))
