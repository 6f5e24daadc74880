"""The unified message table: keys, filters, unions and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import fixed
from threadloom.functions.text import is_blank, py_strip
from threadloom.functions.times import in_year

MESSAGE_SCHEMA = """
    source string, conv_key string, guild_name string, channel_name string,
    conversation_name string, message_id string, author_id string, author_name string,
    content string, ts timestamp_ntz, ts_raw string, is_bot boolean,
    file_name string, ordinal bigint
"""
MESSAGE_COLUMNS = [field.strip().split()[0] for field in MESSAGE_SCHEMA.split(",")]

# Time order inside a conversation; ties keep the order of the export.
TIME_ORDER = ["ts", "file_name", "ordinal"]


def platform() -> Column:
    """A message without a source comes from the first platform."""
    return F.coalesce(F.col("source"), F.lit("discord"))


def conversation_key() -> Column:
    def named(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit("unknown"))

    return F.when(
        F.col("source") == "instagram", F.concat(F.lit("instagram_"), named("conversation_name"))
    ).otherwise(F.concat_ws("_", F.lit("discord"), named("guild_name"), named("channel_name")))


#: The year of ``ts`` as stored tables have it, in directories.
YEAR_COLUMN = "ts_year"


def of_year(messages: DataFrame, year: int) -> DataFrame:
    """The messages of a year; of a stored table only that year's files are read."""
    if YEAR_COLUMN in messages.columns:
        messages = messages.where(F.col(YEAR_COLUMN) == year)
    return messages.where(in_year(F.col("ts"), year))


# --- filters ------------------------------------------------------------------

def has_text(content: Column) -> Column:
    return ~is_blank(content)


def is_attachment_note(content: Column) -> Column:
    return F.contains(F.lower(content), F.lit(fixed.ATTACHMENT_PHRASE))


def is_reaction_note(content: Column) -> Column:
    text = py_strip(content)
    return text.startswith(fixed.REACTION_PREFIX) & F.contains(text, F.lit(fixed.REACTION_PHRASE))


def from_person() -> Column:
    return ~F.coalesce(F.col("is_bot"), F.lit(False))


def identifiers(*settings: str | None) -> list[str]:
    """The identities to look for: the settings that are filled in."""
    return [s for s in settings if s]


def from_author(ids: Sequence[str]) -> Column:
    """Written by a person whose id or name is one of ``ids``."""
    listed = [
        F.coalesce(F.col(c).isin(list(ids)), F.lit(False)) for c in ("author_id", "author_name")
    ]
    return from_person() & (listed[0] | listed[1])


# --- unions ---------------------------------------------------------------------

def merge_messages(*parts: DataFrame) -> DataFrame:
    """Bag union of message tables that may lack each other's columns."""
    merged, *others = parts
    for other in others:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged


# --- statistics (each one is a partial aggregate followed by a small shuffle) ----

def corpus_totals(messages: DataFrame) -> DataFrame:
    # Counting per file first keeps the distinct count from shuffling every row.
    per_file = messages.groupBy("file_name").agg(F.count(F.lit(1)).alias("_n"))
    return per_file.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_messages"),
        F.count("file_name").alias("processed_files"),
    )


def summary_totals(summary: DataFrame, name: str) -> DataFrame:
    """Totals of a per-file or per-conversation summary; ``name`` names the number of rows."""
    return summary.agg(
        F.coalesce(F.sum("message_count"), F.lit(0)).alias("total_messages"),
        F.count(F.lit(1)).alias(name),
    )


def channel_summary(messages: DataFrame) -> DataFrame:
    """Message count per exported file with its guild and channel."""
    return messages.groupBy("file_name", "guild_name", "channel_name").agg(
        F.count(F.lit(1)).alias("message_count")
    )


def conversation_summary(messages: DataFrame, participants: DataFrame) -> DataFrame:
    """Count, participants and final name per inbox directory that has any message."""
    counts = messages.groupBy("conversation_dir").agg(F.count(F.lit(1)).alias("message_count"))
    people = participants.select("conversation_dir", "participants", "conversation_name")
    return counts.join(people, "conversation_dir", "left").withColumn(
        "conversation_name", F.coalesce("conversation_name", F.lit(""))
    )


def source_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy(
        F.when(F.col("source") == "instagram", "instagram").otherwise("discord").alias("source")
    ).agg(F.count(F.lit(1)).alias("n_messages"))


def year_counts(messages: DataFrame, year: int) -> DataFrame:
    """Messages of the year in all and by source, with the whole percentage of the corpus."""
    matches = F.coalesce(in_year(F.col("ts"), year), F.lit(False))
    other = F.coalesce(F.col("source") == "instagram", F.lit(False))
    counted = messages.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(matches).alias("in_year"),
        F.count_if(matches & ~other).alias("discord_in_year"),
        F.count_if(matches & other).alias("instagram_in_year"),
    )
    percent = F.when(
        F.col("total") > 0, F.floor(F.col("in_year") * 100 / F.col("total")).cast("bigint")
    )
    return counted.withColumn("percent", percent)


def author_count(messages: DataFrame, ids: Sequence[str]) -> DataFrame:
    return messages.agg(F.count_if(from_author(ids)).alias("author_messages"))
