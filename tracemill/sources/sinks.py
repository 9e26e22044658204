"""Sinks on plain Parquet and JSON: idempotent run rewrites, upserts, hashed snapshots, artifacts and workbooks."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from functools import cache
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from tracemill.operators.relational import place_across

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
#: Bytes of files that a task hands on at once; a larger file goes alone.
FILES_AT_ONCE = 4_000_000
#: Parts of a file up to so many bytes are stored as they are: setting up a compressor costs more than it saves.
STORED_BYTES = 2_000
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def replace_run(df: DataFrame, path: str, run_column: str = "run_id") -> None:
    """Write rows under their run; a run's earlier rows go, other runs stay."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(run_column).parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """old with new's rows: on a shared key the new row (update) or the old row (keep) stands."""
    if update:
        return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def write_snapshot(df: DataFrame, path: str, keys: list[str]) -> str:
    """Write a version that is never overwritten; returns a hash of its content that row order doesn't change."""
    df.write.mode("error").parquet(path)
    rows = df.sparkSession.read.parquet(path).select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")).alias("s")).first()
    return f"{total['n']}-{total['s']}"


def write_tabs(df: DataFrame, path: str, tab: str) -> None:
    """One folder of rows for each tab."""
    df.write.mode("overwrite").partitionBy(tab).json(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_artifacts(df: DataFrame, path: str, kind: str) -> None:
    """JSON lines with sorted keys, one folder for each kind of artifact; a rewrite replaces the kinds that it holds."""
    names = sorted(c for c in df.columns if c != kind)
    writer = df.select(kind, *names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False)
    writer.partitionBy(kind).json(path)


def workbook_bytes(tabs: list[tuple[str, list[list[str | None]]]]) -> bytes:
    """An .xlsx file of text cells: (name, rows) for each tab, names cut to the 31 characters that the format allows."""
    out = io.BytesIO()

    def sheet(rows: list[list[str | None]]) -> str:
        held = []
        for k, row in enumerate(rows, 1):
            cells = [f'<c r="{_letters(j)}{k}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for j, v in enumerate(row, 1) if v is not None]
            held.append(f'<row r="{k}">{"".join(cells)}</row>')
        return "".join(held)

    def put(part: str, text: str) -> None:
        data = text.encode()
        info = zipfile.ZipInfo(part)
        info.compress_type = zipfile.ZIP_DEFLATED if len(data) > STORED_BYTES else zipfile.ZIP_STORED
        book.writestr(info, data)

    with zipfile.ZipFile(out, "w") as book:
        parts = [f"xl/worksheets/sheet{k}.xml" for k in range(1, len(tabs) + 1)]
        kinds = "".join(f'<Override PartName="/{p}" ContentType="{_TYPE}.worksheet+xml"/>' for p in parts)
        put(
            "[Content_Types].xml",
            f'<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>{kinds}</Types>',
        )
        put("_rels/.rels", f'<Relationships xmlns="{_PACK}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(name[:31], {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>' for k, (name, _) in enumerate(tabs, 1))
        put("xl/workbook.xml", f'<workbook {_MAIN} xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Type="{_REL}/worksheet" Target="{p.removeprefix("xl/")}"/>' for k, p in enumerate(parts, 1))
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACK}/relationships">{links}</Relationships>')
        for part, (_, rows) in zip(parts, tabs, strict=True):
            put(part, f"<worksheet {_MAIN}><sheetData>{sheet(rows)}</sheetData></worksheet>")
    return out.getvalue()


@cache
def _letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def export_workbooks(rows: DataFrame, order: list[str], part_rows: int = 50_000) -> DataFrame:
    """(run_id, part, content): .xlsx files of rows (run_id, tab, fields map<string,string>), tabs by name but Summary first and Findings last.

    A tab's headers are the sorted union of its rows' keys in the file. A run of more than part_rows rows makes several files, so
    that no task holds more than one file's rows; nothing is cut. Only the rows of such runs are placed by ranges.
    """
    place = F.when(F.col("tab") == "Summary", 0).when(F.col("tab") == "Findings", 2).otherwise(1)
    placed = rows.withColumn("_place", place).withColumn("fields", F.to_json("fields"))
    by = ["_place", "tab", *order]
    large = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > part_rows).select(F.col("run_id").alias("_run")).persist()
    parts = placed.withColumn("part", F.lit(0))
    if not large.isEmpty():
        mine = F.col("run_id").eqNullSafe(F.col("_run"))
        small = placed.join(F.broadcast(large), mine, "left_anti")  # one row of `large` for more than part_rows rows
        numbered = place_across(placed.join(F.broadcast(large), mine, "left_semi"), ["run_id"], [F.col(c) for c in by], "_n")
        part = F.floor((F.col("_n") - 1) / part_rows).cast("int")
        parts = small.withColumn("part", F.lit(0)).unionByName(numbered.withColumn("part", part).drop("_n"))
    run = StructField("run_id", rows.schema["run_id"].dataType)
    # rows of a file stand together and in order, so that tasks pass from file to file
    sorted_parts = parts.repartition("run_id", "part").sortWithinPartitions("run_id", "part", *by).select("run_id", "part", "tab", "fields")
    return sorted_parts.mapInArrow(_books, StructType([run, StructField("part", IntegerType()), StructField("content", BinaryType())]))


def _books(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A file for each stretch of rows of one run and part."""
    runs, parts, books, size, kind = [], [], [], 0, None

    def made() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(runs, kind), pa.array(parts, pa.int32()), pa.array(books, pa.binary())], names=["run_id", "part", "content"])
        runs.clear(), parts.clear(), books.clear()
        return out

    for (key, rows), kind in _stretches(batches):
        books.append(_book(rows))
        runs.append(key[0])
        parts.append(key[1])
        size += len(books[-1])
        if size > FILES_AT_ONCE:
            yield made()
            size = 0
    if books:
        yield made()


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.DataType]]:
    key, held, kind = None, [], None
    for batch in batches:
        kind = batch.schema.field("run_id").type
        for run, part, tab, fields in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (run, part) != key:
                if held:
                    yield (key, held), kind
                key, held = (run, part), []
            held.append((tab, fields))
    if held:
        yield (key, held), kind


def _book(rows: list[tuple[str | None, str | None]]) -> bytes:
    tabs: dict[str, list[dict]] = {}
    for tab, fields in rows:
        tabs.setdefault(tab, []).append(json.loads(fields) if fields else {})
    heads = {tab: sorted({k for row in held for k in row}) for tab, held in tabs.items()}
    return workbook_bytes([(tab, [heads[tab], *([row.get(k) for k in heads[tab]] for row in held)]) for tab, held in tabs.items()])


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
