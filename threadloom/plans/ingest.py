"""Exports to the message table and its summaries."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from threadloom.operators.messages import (
    MESSAGE_COLUMNS,
    conversation_summary,
    summary_totals,
)
from threadloom.runtime import drop_path, scratch_path
from threadloom.sinks.tables import write_by_conversation, write_messages, write_summary
from threadloom.sources.html_export import (
    html_channels,
    html_errors,
    html_messages,
    read_html_exports,
    with_channels,
)
from threadloom.sources.inbox import (
    inbox_errors,
    inbox_files,
    inbox_messages,
    inbox_participants,
)
from threadloom.sources.tables import read_messages


@contextmanager
def _stored(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """A parsed table written once to the shared folder, as its uses would parse it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    try:
        yield spark.read.parquet(path)
    finally:
        drop_path(spark, path)


def ingest_html(spark: SparkSession, exports: str, out: str,
                keep_continuations: bool = False) -> DataFrame:
    """HTML exports to ``out/messages`` with summaries, conversations and errors beside it."""
    found = read_html_exports(spark, exports, keep_continuations=keep_continuations)
    with _stored(found, "parsed-html") as raw:
        parsed = with_channels(raw)
        messages = html_messages(parsed)
        write_messages(messages, f"{out}/messages")
        write_by_conversation(messages, f"{out}/by_conversation")
        write_summary(html_channels(parsed), f"{out}/channels")
        write_summary(html_errors(raw), f"{out}/errors")
    channels = spark.read.json(f"{out}/channels")
    write_summary(summary_totals(channels, "processed_files"), f"{out}/totals")
    return read_messages(spark, f"{out}/messages")


def ingest_inbox(spark: SparkSession, inbox: str, out: str, by_directory: bool = False) -> DataFrame:
    """An inbox into the same message table, with summaries and errors beside it.

    ``by_directory`` keeps conversations of equal names in different directories apart.
    """
    files = inbox_files(spark, inbox)
    with _stored(inbox_messages(files, by_directory), "parsed-inbox") as messages:
        write_messages(messages.select(*MESSAGE_COLUMNS), f"{out}/messages")
        write_by_conversation(messages.select(*MESSAGE_COLUMNS), f"{out}/by_inbox_conversation")
        summary = conversation_summary(messages, inbox_participants(files))
        write_summary(summary, f"{out}/conversations")
        write_summary(inbox_errors(files), f"{out}/inbox_errors")
    conversations = spark.read.json(f"{out}/conversations")
    write_summary(
        summary_totals(conversations, "processed_conversations"), f"{out}/inbox_totals"
    )
    return read_messages(spark, f"{out}/messages")
