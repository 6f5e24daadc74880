"""Live messages from a folder of growing logs, one JSON object per line.

A chat client appends to its log; a reader goes on from the byte where it stopped. The offset of
the stream is the end of the last whole line of each file, so a batch is a set of byte ranges
that reads the same whenever it is repeated, and a log may grow, and logs may join, while the
stream runs. Large ranges are cut, so that a long backlog is read by many tasks.

Logs only grow: one that becomes shorter than what was read of it fails the stream, one that
is removed is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from threadloom.functions.times import parse_iso
from threadloom.operators.messages import MESSAGE_COLUMNS, conversation_key
from threadloom.sources.ranges import RANGE_BYTES, STEP_BYTES, cut, file_system, listed
from threadloom.sources.tables import _EXCHANGE_SCHEMA

_LINES = pa.schema([("file", pa.string()), ("position", pa.int64()), ("line", pa.binary())])
_BATCH_LINES = 10_000


class LogRange(InputPartition):
    """The lines that begin in [low, high) of what a batch reads of a log, [first, end)."""

    def __init__(self, path: str, low: int, high: int, first: int, end: int):
        self.path, self.low, self.high, self.first, self.end = path, low, high, first, end


def last_line_end(read, low: int, size: int) -> int:
    """The place behind the last line end in [low, size), or ``low``."""
    high = size
    while high > low:
        start = max(low, high - STEP_BYTES)
        at = read(high - start, start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        high = start
    return low


def range_lines(read, part: LogRange) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines of a range; ``read(n, at)`` gives bytes."""
    low, high, first, end = part.low, part.high, part.first, part.end
    at, data = low, b""
    if low > first:
        # the line that the range before has begun ends here, or later
        at, data = low - 1, read(high - low + 1, low - 1)
        while (cut_at := data.find(b"\n")) < 0 and at + len(data) < end:
            at, data = at + len(data), read(min(STEP_BYTES, end - at - len(data)), at + len(data))
        at, data = at + cut_at + 1, data[cut_at + 1:]
    else:
        data = read(high - low, low)
    while at < high:
        stop = data.find(b"\n")
        while stop < 0:
            more = read(min(STEP_BYTES, end - at - len(data)), at + len(data))
            if not more:
                return
            stop = more.find(b"\n") + len(data) if b"\n" in more else -1
            data += more
        yield at, data[:stop]
        at, data = at + stop + 1, data[stop + 1:]


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", "*.jsonl")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.ends: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, _ = file_system(self.path)
        found = {}
        for path, size in listed(self.path, self.glob):
            known, end = self.ends.get(path, (0, 0))
            if size != known:
                with system.open_input_file(path) as file:
                    end = last_line_end(file.read_at, min(end, size), size)
                self.ends[path] = size, end
            if end:
                found[path] = end
        return found

    def partitions(self, start: dict, end: dict) -> list[LogRange]:
        made = []
        for path, stop in sorted(end.items()):
            first = start.get(path, 0)
            if stop < first:
                raise ValueError(f"{path} was read up to byte {first} and now ends at {stop}")
            made += [LogRange(path, low, high, first, stop) for low, high in cut(first, stop, self.range_bytes)]
        return made

    def read(self, partition: LogRange) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        rows: list[dict] = []
        with system.open_input_file(partition.path) as file:
            for at, line in range_lines(file.read_at, partition):
                rows.append({"file": partition.path, "position": at, "line": line})
                if len(rows) == _BATCH_LINES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_LINES)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=_LINES)

    def commit(self, end: dict) -> None:
        pass


class MessageLogSource(DataSource):
    """``spark.readStream.format("message_log")`` with options ``glob`` and ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return "file string, position bigint, line binary"

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader({k.lower(): v for k, v in self.options.items()})


def stream_message_log(spark: SparkSession, path: str, glob: str = "*.jsonl",
                       range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Messages of all logs below ``path`` as they arrive, in the exchange form of ``read_message_json``.

    ``ordinal`` is the line's place in its log. Blank lines are passed over; a line that is no
    object of that form gives a message whose fields are null.
    """
    spark.dataSource.register(MessageLogSource)
    lines = spark.readStream.format("message_log").options(glob=glob, rangeBytes=range_bytes).load(path)
    text = F.decode("line", "UTF-8")
    parsed = lines.where(F.length(F.trim(text)) > 0).select(
        F.element_at(F.split("file", "/"), -1).alias("file_name"), F.col("position").alias("ordinal"),
        F.from_json(text, _EXCHANGE_SCHEMA).alias("m"))
    return parsed.select("file_name", "ordinal", "m.*").withColumns({
        "conv_key": conversation_key(), "ts": parse_iso(F.col("timestamp")), "ts_raw": F.col("timestamp"),
    }).select(*MESSAGE_COLUMNS)
