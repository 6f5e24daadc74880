"""Unified messages, chat datasets and vector collections that were written before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.times import parse_iso
from threadloom.operators.messages import MESSAGE_COLUMNS, MESSAGE_SCHEMA, YEAR_COLUMN, conversation_key
from threadloom.operators.pairs import CHAT_SCHEMA
from threadloom.sinks.snapshots import read_folders, version

_EXCHANGE_SCHEMA = """
    source string, message_id string, author_id string, author_name string, content string,
    timestamp string, is_bot boolean, guild_name string, channel_name string,
    conversation_name string
"""


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """A message table as ``write_messages`` keeps it, with the year of each message.

    Filters on source and year reach its directories, filters on time its files.
    """
    schema = f"{MESSAGE_SCHEMA}, {YEAR_COLUMN} int"
    folders = version(spark, path).folders
    if not folders:
        return spark.createDataFrame([], schema)
    return read_folders(spark, path, folders, schema).select(*MESSAGE_COLUMNS, YEAR_COLUMN)


def stream_messages(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Messages as files of them arrive; ``max_files`` bounds a micro-batch."""
    stream = spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", max_files)
    return stream.parquet(path)


def read_message_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Exchange JSON (arrays, or one object per line with ``multi_line=False``).

    Only the line form can be split between tasks. Timestamps are ISO text whose
    zone suffix is not applied.
    """
    place = F.monotonically_increasing_id()
    found = spark.read.schema(_EXCHANGE_SCHEMA).json(path, multiLine=multi_line)
    return (
        found.select("*", F.col("_metadata.file_name").alias("file_name"), place.alias("ordinal"))
        .withColumns({
            "conv_key": conversation_key(), "ts": parse_iso(F.col("timestamp")),
            "ts_raw": F.col("timestamp"),
        })
        .select(*MESSAGE_COLUMNS)
    )


def read_chat(spark: SparkSession, *paths: str, multi_line: bool = False) -> DataFrame:
    """Chat examples from JSON files or directories, e.g. train and validation together."""
    return spark.read.schema(CHAT_SCHEMA).json(list(paths), multiLine=multi_line)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """A vector collection; a filter on ``metadata.type`` should name ``type`` to prune."""
    return spark.read.parquet(path)
