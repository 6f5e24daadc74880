"""Context-to-reply pairs, chat examples and the train / validation split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import fixed
from threadloom.functions.text import line, py_strip
from threadloom.operators.messages import TIME_ORDER, from_author, has_text, of_year
from threadloom.operators.ordered import HOT_ROWS, previous_rows
from threadloom.runtime import stored

CHAT_SCHEMA = "example_id string, conversations array<struct<role:string,content:string>>"


def training_pairs(
    messages: DataFrame,
    author_ids: Sequence[str],
    year: int | None = None,
    context: int = fixed.CONTEXT_FRAME,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Replies of the author, each with the lines of the ``context`` messages before it.

    Blank messages occupy a place in the frame but add no line. A pair needs a
    line, hence an earlier message, so one-message conversations drop out without
    a count of their own and the year filter stays directly above the scan.
    """
    if year is not None:
        messages = of_year(messages, year)
    text = py_strip(F.col("content"))
    slim = messages.select(
        "conv_key", "message_id", *TIME_ORDER,
        F.when(has_text(F.col("content")), line(F.col("author_name"), text)).alias("_line"),
        F.when(from_author(author_ids), text).alias("response"),
    )
    framed = previous_rows(
        slim, ["conv_key"], TIME_ORDER, context, F.col("_line"), "_context", hot_rows
    )
    return framed.where(
        (F.length("response") > 0) & (F.size("_context") > 0)
    ).select(
        "conv_key", "message_id", "ts", "file_name", "ordinal",
        F.array_join("_context", "\n").alias("instruction"), "response",
    )


def example_id() -> Column:
    """A stable id from what identifies the reply's message."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
             ("conv_key", "message_id", "file_name", "ordinal")]
    return F.md5(F.concat_ws("|", *parts))


def chat_examples(pairs: DataFrame) -> DataFrame:
    def turn(role: str, text: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.col(text).alias("content"))

    return pairs.select(
        example_id().alias("example_id"),
        F.array(turn("user", "instruction"), turn("assistant", "response")).alias("conversations"),
    )


def render_chat(conversations: Column) -> Column:
    """A conversation as training text, one marked block per turn."""
    blocks = F.transform(
        conversations,
        lambda m: F.concat(
            F.lit(fixed.IM_START), m["role"], F.lit("\n"), m["content"], F.lit(fixed.IM_END + "\n")
        ),
    )
    return F.array_join(blocks, "")


# --- split ----------------------------------------------------------------------

def _digest(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("example_id")))


def hash_split(
    examples: DataFrame, ratio: float = fixed.TRAIN_RATIO, seed: int = 0
) -> DataFrame:
    """Adds ``split``: a row-local, reproducible draw with probability ``ratio``."""
    draw = F.conv(F.substring(_digest(seed), 1, 8), 16, 10).cast("bigint")
    is_train = draw < F.lit(int(ratio * 2**32))
    return examples.withColumn("split", F.when(is_train, "train").otherwise("val"))


def exact_split(
    examples: DataFrame, ratio: float = fixed.TRAIN_RATIO, seed: int = 0
) -> DataFrame:
    """Adds ``split`` with exactly ``int(n * ratio)`` rows in ``train``.

    The order is that of a seeded digest. The input is evaluated once and stored with
    its digests. Counts per four-digit digest prefix (65,536 rows at most) say which
    prefix holds the cut; only its rows, one in 65,536 of the table, are ranked.
    """
    digest = _digest(seed)
    keyed = stored(
        examples.withColumns({"_digest": digest, "_bin": F.substring(digest, 1, 4)}), "digests"
    )
    every = Window.partitionBy(F.lit(0))
    bins = (
        keyed.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(every.orderBy("_bin")))
        .withColumn("_cut", F.floor(F.sum("_n").over(every) * F.lit(ratio)))
        .select("_bin", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", "_cut")
    )
    placed = keyed.join(F.broadcast(bins), "_bin")
    split_bin = (F.col("_before") < F.col("_cut")) & (F.col("_cut") < F.col("_upto"))
    whole = placed.where(~split_bin).withColumn("_place", F.col("_before") + 1)
    rank = F.row_number().over(Window.partitionBy("_bin").orderBy("_digest", "example_id"))
    ranked = placed.where(split_bin).withColumn("_place", F.col("_before") + rank)
    return whole.unionByName(ranked).select(
        *examples.columns,
        F.when(F.col("_place") <= F.col("_cut"), "train").otherwise("val").alias("split"),
    )


def split_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n_examples"))
