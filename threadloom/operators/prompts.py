"""Recent history, rolling memory and prompt assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import fixed
from threadloom.operators.ordered import HOT_ROWS, previous_rows


def system_text(assistant_name: str) -> str:
    """The live service's system text for an assistant of that name."""
    return fixed.SERVICE_SYSTEM_TEXT.format(name=assistant_name)


def history_line(author: Column, text: Column) -> Column:
    return F.concat(author, F.lit(": "), text)


def with_history(messages: DataFrame, channel: list[str], order: list[str],
                 limit: int = fixed.HISTORY_LIMIT, author: str = "author_name",
                 content: str = "content", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``history``: lines of the channel's last ``limit`` messages, oldest first.

    Bots take up places among the ``limit`` but contribute no line.
    """
    person = ~F.coalesce(F.col("is_bot"), F.lit(False))
    said = F.when(person, history_line(F.col(author), F.col(content)))
    return previous_rows(messages, channel, order, limit, said, "history", hot_rows)


def with_memory(turns: DataFrame, session: list[str], order: list[str], is_user: Column,
                text: Column, entries: int = fixed.MEMORY_ENTRIES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``memory``: the session's last entries as ``You: …`` and ``Bot: …`` lines."""
    entry = F.concat(F.when(is_user, F.lit("You: ")).otherwise(F.lit("Bot: ")), text)
    return previous_rows(turns, session, order, entries, entry, "memory", hot_rows)


def prompt(user_text: Column, history: Column, contexts: Column, system: str | Column) -> Column:
    """The templated prompt; empty or null lists leave their section out."""

    def section(header: str, items: Column, prefix: str) -> Column:
        lines = F.transform(items, lambda i: F.concat(F.lit(prefix), i, F.lit("\n")))
        return F.when(
            F.size(items) > 0, F.concat(F.lit(header), F.array_join(lines, ""))
        ).otherwise(F.lit(""))

    opening = F.lit(system) if isinstance(system, str) else system
    return F.concat(
        F.lit(f"{fixed.IM_START}system\n"), opening,
        section(fixed.HISTORY_HEADER, history, ""),
        section(fixed.CONTEXT_HEADER, contexts, "- "),
        F.lit(f"{fixed.IM_END}\n{fixed.IM_START}user\n"), user_text,
        F.lit(f"{fixed.IM_END}\n{fixed.IM_START}assistant\n"),
    )


def assemble_prompts(requests: DataFrame, contexts: DataFrame, system: str) -> DataFrame:
    """Adds ``contexts`` and ``prompt`` to (request_id, user_text, history, …) rows.

    ``contexts`` has one (query_id, contexts) row per request at most.
    """
    looked_up = contexts.withColumnRenamed("query_id", "request_id")
    return requests.join(looked_up, "request_id", "left").withColumn(
        "prompt", prompt(F.col("user_text"), F.col("history"), F.col("contexts"), system)
    )
