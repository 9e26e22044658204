"""A data source for delimited files that stops reading once it has what was asked for.

Every file is one partition and is streamed, unpacked on the way if it is a .gz. Reading ends when each class has its rows, so a huge
file costs what its beginning costs. What the files have found, at most classes * rows a file, is cut to the rows wanted over
all files by a window in the order of the files.
"""

from __future__ import annotations

import csv
import io
import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = "file string, line long, class string, values map<string,string>"


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The files of a folder by name, without hidden ones and markers such as _SUCCESS; or the file itself."""
    system, inner = _located(path)
    if system.get_file_info(inner).type != pafs.FileType.Directory:
        return [path]
    names = sorted(f.base_name for f in system.get_file_info(pafs.FileSelector(inner)) if f.type == pafs.FileType.File)
    return [f"{path.rstrip('/')}/{n}" for n in names if n[0] not in "._"]


def lines_of(path: str) -> io.TextIOWrapper:
    """The text of a file as a stream; bytes that aren't UTF-8 are replaced."""
    system, inner = _located(path)
    raw = system.open_input_stream(inner, compression="gzip" if path.endswith(".gz") else None)
    return io.TextIOWrapper(io.BufferedReader(_Readable(raw), 1 << 16), "utf-8", "replace", newline="")


class _Readable(io.RawIOBase):
    """A stream of pyarrow as one of Python, read in the pieces that are asked for."""

    def __init__(self, stream: pa.NativeFile):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        piece = self.stream.read(len(buffer))
        buffer[: len(piece)] = piece
        return len(piece)

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


def wanted_rows(lines, separator: str, class_of: str, classes: list[str], rows: int, needed: list[str]) -> Iterator[tuple[int, str, dict[str, str]]]:
    """(line from 1, class, values by the header's names) until each class has its rows. Without classes one class holds all rows.

    A row is passed over if a needed column is empty or its class isn't wanted. A short row's missing values are empty, surplus ones go.
    """
    left = Counter(dict.fromkeys(classes or [""], rows))
    reader = csv.DictReader(lines, delimiter=separator, restval="")
    while any(n > 0 for n in left.values()):
        row = next(reader, None)
        if row is None:
            return
        row = {k: v.strip() for k, v in row.items() if k is not None}
        found = row.get(class_of, "") if classes else ""
        if left[found] > 0 and all(row.get(c) for c in needed):
            left[found] -= 1
            yield reader.line_num, found, row


class EarlyStop(DataSource):
    """Format early_stop. Options: path (a folder or a file), separator, classOf, classes (JSON list), rows (per class and file), needed (JSON list)."""

    @classmethod
    def name(cls) -> str:
        return "early_stop"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.rows, self.separator, self.class_of = low["path"], int(low["rows"]), low.get("separator", "\t"), low.get("classof", "")
        self.classes, self.needed = json.loads(low.get("classes", "[]")), json.loads(low.get("needed", "[]"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in listed(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with lines_of(partition.value) as lines:
            for line, found, row in wanted_rows(lines, self.separator, self.class_of, self.classes, self.rows, self.needed):
                yield partition.value.rsplit("/", 1)[-1], line, found, row


def first_rows(spark: SparkSession, path: str, rows: int, class_of: str = "", classes: tuple[str, ...] = (), needed: tuple[str, ...] = (), separator: str = "\t") -> DataFrame:
    """The first rows of each class over all files, in the order of their names: (file, line, class, values).

    A file that is empty or has a header only gives none. More rows are never read from a file than it takes to fill its classes.
    """
    spark.dataSource.register(EarlyStop)
    found = spark.read.format("early_stop").options(classOf=class_of, classes=json.dumps(list(classes)), rows=rows, needed=json.dumps(list(needed)), separator=separator).load(path)
    order = Window.partitionBy("class").orderBy("file", "line")
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= rows).drop("_n")
