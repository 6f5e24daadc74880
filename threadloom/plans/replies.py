"""Trigger messages to prompts, model output to replies and image jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import fixed
from threadloom.functions.text import (
    cap_reply,
    clean_image_prompt,
    clean_reply,
    command_argument,
    image_file_name,
    image_prompt,
    mentions,
    without_mentions,
)
from threadloom.operators.prompts import assemble_prompts, system_text
from threadloom.operators.retrieval import mixed_context


def trigger_texts(content: Column, bot_id: str, command: str) -> Column:
    """One entry per trigger a message pulls: (trigger, user_text)."""
    def entry(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("trigger"), text.alias("user_text"))

    called = entry("command", command_argument(content, command))
    mentioned = entry(
        "mention", F.when(mentions(content, bot_id), without_mentions(content, bot_id))
    )
    return F.filter(F.array(called, mentioned), lambda e: e["user_text"].isNotNull())


def triggers(messages: DataFrame, bot_id: str, command: str) -> DataFrame:
    """Adds ``trigger`` and ``user_text`` and keeps the triggering messages of others.

    Works on batches and on streams. Commands of bots are ignored, mentions are not.
    """
    others = messages.where(~F.col("author_id").eqNullSafe(F.lit(bot_id)))
    found = trigger_texts(F.col("content"), bot_id, command)
    pulled = F.filter(
        found, lambda e: (e["trigger"] == "mention") | ~F.coalesce(F.col("is_bot"), F.lit(False))
    )
    return others.select("*", F.inline(pulled))


def prompts(requests: DataFrame, collection: DataFrame, embedded: DataFrame,
            assistant_name: str, **options) -> DataFrame:
    """(request_id, user_text, history, …) rows with ``contexts`` and ``prompt`` added.

    ``embedded`` holds (query_id, text, embedding) for the same requests.
    """
    contexts = mixed_context(collection, embedded, **options)
    return assemble_prompts(requests, contexts, system_text(assistant_name))


def replies(generated: DataFrame, assistant_name: str,
            max_chars: int = fixed.MAX_REPLY_CHARS) -> DataFrame:
    """Adds ``reply`` (cleaned and capped) and ``image_prompt`` from column ``raw_reply``.

    The image command is looked up before the reply is capped.
    """
    cleaned = generated.withColumn("_clean", clean_reply(F.col("raw_reply"), assistant_name))
    return cleaned.withColumns({
        "reply": cap_reply(F.col("_clean"), max_chars), "image_prompt": image_prompt(F.col("_clean"))
    }).drop("_clean")


def image_jobs(replied: DataFrame) -> DataFrame:
    """The replies that ask for an image: (request_id, prompt, file_name)."""
    prompt = clean_image_prompt(F.col("image_prompt"))
    return replied.where(F.col("image_prompt").isNotNull()).select(
        "request_id", prompt.alias("prompt"), image_file_name(prompt).alias("file_name")
    )
