"""Messages from an inbox: one directory per conversation with ``message_*.json`` files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import py_strip
from threadloom.functions.times import from_epoch_millis, iso_text
from threadloom.operators.messages import (
    MESSAGE_COLUMNS,
    conversation_key,
    is_attachment_note,
    is_reaction_note,
)
from threadloom.sources.files import whole_files

_FILE_SCHEMA = "participants array<struct<name:string>>, messages array<string>"
_MESSAGE_SCHEMA = "sender_name string, timestamp_ms bigint, content string"


def inbox_files(spark: SparkSession, inbox: str) -> DataFrame:
    """(conversation_dir, file_name, value); dot directories are not part of an inbox."""
    files = whole_files(spark, f"{inbox.rstrip('/')}/*/message_*.json")
    folder = F.element_at(F.split("path", "/"), -2)
    named = files.select(folder.alias("conversation_dir"), "file_name", "value")
    return named.where(~F.col("conversation_dir").startswith("."))


def inbox_errors(files: DataFrame) -> DataFrame:
    """(file_name, error) of the files that are no valid JSON text."""
    marked = F.from_json(
        "value", _FILE_SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}
    )
    reason = F.when(F.col("value").isNull(), "not valid UTF-8").when(
        F.col("_read").isNull() | F.col("_read._bad").isNotNull(), "not valid JSON")
    return files.withColumn("_read", marked).select(
        F.concat_ws("/", "conversation_dir", "file_name").alias("file_name"), reason.alias("error")
    ).where(F.col("error").isNotNull())


def inbox_participants(files: DataFrame) -> DataFrame:
    """Per directory: participants and joined name, from the first file that lists any."""
    people = F.from_json("value", "participants array<struct<name:string>>")["participants"]
    listed = files.select("conversation_dir", "file_name", people.alias("people")).where(
        F.size("people") > 0
    )
    first = listed.groupBy("conversation_dir").agg(
        F.min("file_name").alias("first_file"), F.min_by("people", "file_name").alias("people")
    )
    names = F.transform("people", lambda p: F.coalesce(p["name"], F.lit("Unknown")))
    return first.select(
        "conversation_dir", "first_file",
        F.transform("people", lambda p: p["name"]).alias("participants"),
        F.array_join(names, ", ").alias("conversation_name"),
    )


def inbox_messages(files: DataFrame, by_directory: bool = False) -> DataFrame:
    """(conversation_dir, file_name, value) files to the message table plus ``conversation_dir``.

    Left out: blank messages, attachment notes, reactions and anything with a
    ``share`` key, even a null one. ``by_directory`` keys conversations by their
    directory instead of by the joined names.
    """
    raw = files.select(
        "conversation_dir", "file_name",
        F.posexplode(F.from_json("value", _FILE_SCHEMA)["messages"]).alias("ordinal", "_json"),
    )
    parsed = raw.withColumn("_m", F.from_json("_json", _MESSAGE_SCHEMA)).withColumn(
        "content", py_strip(F.col("_m.content"))
    )
    content = F.col("content")
    shared = F.coalesce(F.array_contains(F.json_object_keys("_json"), "share"), F.lit(False))
    kept = parsed.where(
        (F.length(content) > 0) & ~is_attachment_note(content) & ~is_reaction_note(content)
        & ~shared
    )
    people = inbox_participants(files)
    sender = F.coalesce("_m.sender_name", F.lit("Unknown"))
    millis = F.nullif(F.col("_m.timestamp_ms"), F.lit(0))
    stamp = F.coalesce(millis.cast("string"), F.md5("content"))
    # Files ahead of the first participant list have an empty conversation name.
    name = F.when(F.col("file_name") >= F.col("first_file"), F.col("conversation_name"))
    filled = kept.join(people, "conversation_dir", "left").select(
        F.lit("instagram").alias("source"),
        F.lit(None).cast("string").alias("guild_name"),
        F.lit(None).cast("string").alias("channel_name"),
        F.coalesce(name, F.lit("")).alias("conversation_name"),
        F.concat(F.lit("ig_"), stamp).alias("message_id"),
        sender.alias("author_id"), sender.alias("author_name"), "content",
        from_epoch_millis(millis).alias("ts"), F.lit(False).alias("is_bot"),
        F.concat_ws("/", "conversation_dir", "file_name").alias("file_name"),
        F.col("ordinal").cast("bigint").alias("ordinal"), "conversation_dir",
    )
    key = conversation_key()
    if by_directory:
        key = F.concat(F.lit("instagram_"), F.col("conversation_dir"))
    return filled.withColumns(
        {"ts_raw": iso_text(F.col("ts")), "conv_key": key}
    ).select(*MESSAGE_COLUMNS, "conversation_dir")
