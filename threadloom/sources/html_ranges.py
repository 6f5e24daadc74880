"""HTML exports of any size, each read by many tasks.

A range of bytes owns the message containers whose start tag begins in it; the task that
reads it reads on to the next container behind its end. A container is known by its start
tag, whatever attributes it has or lacks, as in the whole-file form, and its record carries the
whole tag. The text before a file's first container is the file's own record; an empty file has none.

Containers inside comments or scripts count here. Grouped messages without a header are left out;
``read_html_exports`` can keep them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from threadloom.sources.html_export import (
    _CONTAINER, _NOT_TEXT, _PARSED, _PARSED_SQL, _attributes, _channel, _message, _tree,
)
from threadloom.sources.ranges import RANGE_BYTES, STEP_BYTES, cut, file_system, listed

_OPENING = re.compile(rb"<div(?=[\s/>])((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.IGNORECASE)
_LOOSE = re.compile(rb"<div(?=[\s/>])([^>]*)>", re.IGNORECASE)
_RECORDS = pa.schema([
    ("file", pa.string()), ("ordinal", pa.int64()), ("first", pa.bool_()), ("value", pa.binary()),
])
_BATCH_BYTES = 4 << 20


def _is_container(attributes: bytes) -> bool:
    return _CONTAINER in _attributes(attributes.decode("utf-8", "replace")).get("class", "").split()


def container_starts(data: bytes, start: int, final: bool) -> tuple[list[int], int]:
    """Where containers start from ``start`` on, and where to go on once there is more data."""
    found, at = [], start
    while True:
        at = data.find(b"<", at)
        if at < 0:
            return found, len(data)
        if data[at:at + 4].lower() == b"<div":
            tag = _OPENING.match(data, at)
            if not tag and not final:
                return found, at  # the rest of the tag may follow
            tag = tag or _LOOSE.match(data, at)
            if tag and _is_container(tag.group(1)):
                found.append(at)
            at = tag.end() if tag else at + 1
        elif not final and len(data) - at < 4:
            return found, at
        else:
            at += 1


class ExportRange(InputPartition):
    def __init__(self, path: str, low: int, high: int, size: int):
        self.path, self.low, self.high, self.size = path, low, high, size


def range_records(read, low: int, high: int, size: int) -> Iterator[tuple[int, bool, bytes]]:
    """(offset, is the file's own, bytes) of the records of [low, high); ``read(n, at)`` gives bytes."""
    data = read(high - low, low)
    starts, resume = container_starts(data, 0, low + len(data) >= size)
    # a container that another range owns ends the last record of this one
    while low + len(data) < size and not (starts and low + starts[-1] >= high):
        if not starts and low > 0 and low + resume >= high:
            return  # nothing begins here
        data += read(STEP_BYTES, low + len(data))
        more, resume = container_starts(data, resume, low + len(data) >= size)
        starts += more
    own = [s for s in starts if low + s < high]
    if low == 0:
        yield 0, True, data[:starts[0] if starts else len(data)]
    for i, start in enumerate(own):
        yield low + start, False, data[start:starts[i + 1] if i + 1 < len(starts) else len(data)]


class ExportReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", "*.html")
        self.recursive = str(options.get("recursive", "false")).lower() == "true"
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[ExportRange]:
        return [
            ExportRange(f.path, low, high, f.size) for f in listed(self.path, self.glob, self.recursive)
            for low, high in cut(0, f.size, self.range_bytes)
        ]

    def read(self, partition: ExportRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        system, _ = file_system(self.path)
        rows, held = [], 0
        with system.open_input_file(partition.path) as file:
            for at, first, value in range_records(file.read_at, partition.low, partition.high, partition.size):
                rows.append({"file": partition.path, "ordinal": at, "first": first, "value": value})
                held += len(value)
                if held > _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                    rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)


class ExportSource(DataSource):
    """``spark.read.format("chat_export")`` with options ``glob``, ``recursive`` and ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "chat_export"

    def schema(self) -> str:
        return "file string, ordinal bigint, first boolean, value binary"

    def reader(self, schema) -> ExportReader:
        return ExportReader({k.lower(): v for k, v in self.options.items()})


def _rows(record: dict) -> Iterator[dict]:
    base = {"file_name": record["file"]}
    try:
        text = record["value"].decode().replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError:
        yield base | {"error": _NOT_TEXT}  # spoils the file, as in the whole-file form
        return
    if record["first"]:
        yield base | _channel(_tree(text))
        return
    here = base | {"ordinal": record["ordinal"]}
    try:
        message = _message(_tree(text).first("div", _CONTAINER))
    except Exception as failure:
        yield here | {"error": f"message: {failure!r}"}
        return
    if message:
        yield here | message


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pylist([r for record in batch.to_pylist() for r in _rows(record)], schema=_PARSED)


def read_html_ranges(spark: SparkSession, path: str, glob: str = "*.html", recursive: bool = False,
                     range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Raw rows like ``read_html_exports``, ``file_name`` being the whole path; large files in many tasks.

    Messages do not know their channel yet: store the rows and pass them through ``with_channels``.
    ``ordinal`` is the container's place in bytes.
    """
    spark.dataSource.register(ExportSource)
    records = spark.read.format("chat_export").options(
        glob=glob, recursive=recursive, rangeBytes=range_bytes).load(path)
    return records.mapInArrow(_parse, _PARSED_SQL)
