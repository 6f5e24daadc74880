"""The driver's tables seen as messages, channels, vectors and markdown.

Every view covers its whole table. The SQL twins live in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import fixed
from threadloom.functions.metadata import metadata
from threadloom.operators.messages import MESSAGE_COLUMNS, conversation_key
from threadloom.functions.times import iso_text


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stamp() -> Column:
    """Years change inside a conversation, pairs of turns share a minute."""
    return F.expr(
        "make_timestamp_ntz(cast(2024 + (conv_id + turn div 3) % 3 as int), 1, 1, 0, 0, 0)"
        " + make_dt_interval(0, cast(conv_id as int), cast(turn div 2 as int), 0)"
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as a message table: odd conversations from the second platform."""
    other = F.col("conv_id") % 2 == 1
    place = F.concat(F.lit("c"), F.col("conv_id"))
    turns = table(spark, sf, "conversations").select(
        F.when(other, "instagram").alias("source"),
        F.when(~other, "g").alias("guild_name"),
        F.when(~other, place).alias("channel_name"),
        F.when(other, place).alias("conversation_name"),
        F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn").alias("message_id"),
        F.col("role").alias("author_id"), F.col("role").alias("author_name"),
        F.col("text").alias("content"), stamp().alias("ts"),
        (F.col("role") == "system").alias("is_bot"),
        F.concat(F.lit("f"), "conv_id").alias("file_name"), F.col("turn").alias("ordinal"),
    )
    return turns.withColumns(
        {"conv_key": conversation_key(), "ts_raw": iso_text(F.col("ts"))}
    ).select(*MESSAGE_COLUMNS)


def channels(spark: SparkSession, sf: str) -> DataFrame:
    """Events as channel messages; a purchase triggers, an error is a bot's."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("channel"), "ts", "event_id",
        F.col("event_type").alias("author_name"), F.col("props").alias("content"),
        (F.col("event_type") == "error").alias("is_bot"),
    )


def collection(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with their documents; labels below five are messages, the others docs."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    label = F.col("label").cast("string")
    is_message = F.col("label") < 5
    described = metadata(
        type=F.when(is_message, fixed.MESSAGE_TYPE).otherwise(fixed.DOCS_TYPE),
        channel_name=F.when(is_message, F.concat(F.lit("ch"), label)),
        title=F.when(~is_message, F.concat(F.lit("T"), label)),
    )
    return table(spark, sf, "embeddings").join(texts, "vec_id", "left").select(
        F.col("vec_id").alias("id"), F.coalesce("text", F.lit("")).alias("document"),
        "embedding", described.alias("metadata"), "label",
    )


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts, some of them made to ask for docs, with the vector of their number."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return table(spark, sf, "benchmark").join(vectors, "item_id").select(
        F.col("item_id").alias("query_id"),
        F.replace("text", F.lit("hein"), F.lit("Motor")).alias("text"), "embedding",
    )


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose short lines ending in a full stop become headings."""
    text = F.regexp_replace("text", r"(?m)^([^\n]{1,40}\.)$", "## $1")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("/docs/source/a/b/d"), "doc_id", F.lit(".md")).alias("path"),
        text.alias("value"),
    )
