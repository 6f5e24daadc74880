"""Preference data: one prompt and two masked completions from pairs of conversations.

The longest common prefix of two conversations ends before the first turn whose role or text
differs, or that one of them lacks. It is found by comparing turn by turn and taking the
least differing turn, so no conversation is gathered for it. The prefix is rendered once as
``prompt``, from the chosen side; what follows is ``chosen`` and ``rejected``. Rendered text
comes in parts of at most ``part_turns`` turns each (one part, unless a conversation is
longer), so that a conversation of any length stays in bounded rows. Each part has the
character spans of assistant texts with their end marks, on which a loss counts; prompts have none.

Turns order by (turn, role, text); their position, not their number, is compared, so gaps
and repeated numbers are allowed. Null roles and texts count as empty. Rows without a
conversation are left out. A pair with one side only has no common prefix; the absent side
has no parts. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import running, stored

OPEN, MIDDLE, END, LAST = "<|", "|>\n", "\n<|end|>", "\n"
#: Turns that the two sides of a pair made from neighbours share.
FORK = 2


def neighbours(conversations: DataFrame, fork: int = FORK) -> DataFrame:
    """Turns with pair and side, one pair per conversation.

    Its chosen side is the conversation, its rejected side the turns numbered below ``fork``, which it
    shares, and from there on the turns of the conversation with the next number.
    """
    turn = F.coalesce("turn", F.lit(-1))
    own = F.struct(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"))
    shared = F.struct(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"))
    lent = F.struct((F.col("conv_id") - 1).alias("pair_id"), F.lit("rejected").alias("side"))
    sides = F.explode(F.array(own, F.when(turn < fork, shared).otherwise(lent)))
    return conversations.filter("conv_id is not null").select(sides.alias("s"), "turn", "role", "text").select(
        "s.pair_id", "s.side", "turn", "role", "text")


def positions(turns: DataFrame, chunk: int) -> DataFrame:
    """Adds ``at``, the turn's place in its conversation, in two bounded steps.

    Turns are counted per run of ``chunk`` turn numbers; a turn's place is the count of the
    runs before plus its place in its run.
    """
    run = F.expr(f"coalesce(turn, -1) div {chunk}")
    dealt = turns.select("pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), run.alias("run"))
    before = Window.partitionBy("pair_id", "side").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("pair_id", "side", "run").agg(F.count("*").alias("n")).select(
        "pair_id", "side", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("pair_id", "side", "run").orderBy("turn", "role", "text")
    return dealt.withColumn("in_run", F.row_number().over(inside)).join(counts, ["pair_id", "side", "run"]).select(
        "pair_id", "side", "role", "text", (F.col("before") + F.col("in_run") - 1).alias("at")
    )


def common_prefix(placed: DataFrame) -> DataFrame:
    """(pair_id, prefix): turns that both sides share from the start."""
    both = placed.groupBy("pair_id", "at").agg(
        F.count("*").alias("n"), F.min(F.struct("role", "text")).alias("a"), F.max(F.struct("role", "text")).alias("b")
    )
    differs = (F.col("n") < 2) | (F.col("a") != F.col("b"))
    return both.groupBy("pair_id").agg(
        F.coalesce(F.min(F.when(differs, F.col("at"))), F.max("at") + 1).alias("prefix")
    )


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(END + LAST))


def preference_parts(turns: DataFrame, part_turns: int = 64) -> DataFrame:
    """(pair_id, part, part_no, n_turns, prefix_turns, text, loss_spans).

    ``turns``: pair_id, side ('chosen' or 'rejected'), turn, role, text.
    """
    placed = stored(positions(turns, part_turns), "preference-turns")
    lengths = common_prefix(placed).withColumnRenamed("pair_id", "_pair")
    joined = placed.join(lengths, F.col("pair_id") == F.col("_pair"))
    shared = F.col("at") < F.col("prefix")
    parts = joined.filter(~shared | (F.col("side") == "chosen")).select(
        "pair_id", F.when(shared, "prompt").otherwise(F.col("side")).alias("part"),
        F.when(shared, F.col("at")).otherwise(F.col("at") - F.col("prefix")).alias("place"),
        F.col("prefix").alias("prefix_turns"), "role", "text",
    ).withColumn("part_no", F.expr(f"place div {part_turns}"))
    grouped = parts.groupBy("pair_id", "part", "part_no").agg(
        F.first("prefix_turns").alias("prefix_turns"), F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"),  # part_turns at most
    )
    sizes = F.transform("turns", lambda t: len(OPEN + MIDDLE + END + LAST) + F.length(t["role"]) + F.length(t["text"]))

    def lost(t: Column, stop: Column) -> Column:
        return F.struct((stop - len(END + LAST) - F.length(t["text"])).alias("start"), (stop - len(LAST)).alias("stop"),
                        ((F.col("part") != "prompt") & (t["role"] == "assistant")).alias("counts"))

    spans = F.filter(F.zip_with("turns", running(sizes, lambda a, x: a + x), lost), lambda s: s["counts"])
    return grouped.select(
        "pair_id", "part", "part_no", "n_turns", "prefix_turns",
        F.array_join(F.transform("turns", lambda t: _rendered(t["role"], t["text"])), "").alias("text"),
        F.transform(spans, lambda s: F.struct(s["start"], s["stop"])).alias("loss_spans"),
    )
