"""Mixing sources to target weights.

Each source's documents, in a fixed pseudorandom order, form one stream of words that is cut
into blocks of ``block_words``. A source's target is its share by weight, never above twice
its words; the rest is shared again by weight. The target is taken in passes: a pass visits
blocks in the order of a pseudorandom permutation of the block numbers, no block twice, and
the last block visited is cut where the target is reached. For every block to take, a draw
names its output shard; the draws of a source are multinomial over shards, and a shard's
counts per source are the sums of its draws. The counts open slots; a slot's number goes
through the source's permutation to a block number, and slots join documents by block. What a
slot takes of a document is a piece: a range of its words, at a place in a shard. A mixed text
is its pieces' words as drawn, cut or repeated; ``mixed_blocks`` gives the pieces by shard.

Only sizes and numbers are shuffled in the draws; texts move once, to meet their pieces. A source of any size is spread by its
document buckets, slots and blocks; no step gathers a source in one task. Slots and pieces unfold from small tables, by whose
sizes Catalyst would broadcast them, through the driver: their joins are merge joins by hint.

Null texts have no words and take none. Sources come in code point order, null last. Equal
rows are told apart by their place in the stream. All draws are hashes of a seed, so that a
rerun repeats them. An empty table gives an empty mix. Extra columns stay; those named like
the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import aside, fresh, let, plain_words, stored

WEIGHTS = (3, 1, 2)
MOST_REPEATS = 2
ROUNDS = 16
RESULTS = ("size", "source_size", "target", "taken", "pieces")
#: Behind every word: pieces of a text split there hold a word and the white space before it.
BEHIND_WORD = r"(?<=[^ \t\n\x0B\f\r])(?=[ \t\n\x0B\f\r])"
SHARE_PERCENT = 150


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT) -> DataFrame:
    """(source, source_size) to (source, rank, source_size, target).

    The common rate per weight at which the uncapped sources share what the capped ones
    leave is found in one pass over the sources in order of cap per weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumns({
        "weight": F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"),
        "cap": MOST_REPEATS * F.col("source_size"),
    })
    rated = ranked.withColumns({
        "goal": F.sum("source_size").over(everything) * (percent / 100),
        "spent": F.coalesce(F.sum("cap").over(by_cap), F.lit(0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0)),
    })
    rate = (F.col("goal") - F.col("spent")) / F.col("open")
    fits = F.when(rate * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", rate.alias("rate")))
    rated = rated.withColumn("rate", F.min(fits).over(everything)["rate"])
    target = F.least(F.col("cap").cast("double"), F.col("rate") * F.col("weight"))
    return rated.select("source", "rank", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def _bits(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def permuted(number: Column, size: Column, key: Column, inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0..size-1: swap-or-not rounds, each its own inverse."""
    rounds = F.array(*(F.lit(r) for r in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))))

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(_bits(key, r), size) - x, size)
        swap = F.pmod(_bits(key, r, F.greatest(x, partner)), F.lit(2)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(rounds, number.cast("long"), step)


def plan_of(goals: DataFrame, block_words: int, seed: int) -> DataFrame:
    """Per source and pass: words and slots to take, blocks, and the slot of the short last block."""
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    base = goals.filter("source_size > 0").select(
        "source", "rank", "source_size", blocks.alias("blocks"),
        F.round("target").cast("long").alias("words"),
    )
    base = base.withColumn("tail", F.col("source_size") - (F.col("blocks") - 1) * block_words)
    passes = F.array(*(
        F.struct(F.lit(p).alias("pass"), F.greatest(F.least(F.col("words") - p * F.col("source_size"), F.col("source_size")), F.lit(0)).alias("take"))
        for p in range(MOST_REPEATS)
    ))
    each = base.select("*", F.explode(passes).alias("p")).select(
        "source", "rank", "blocks", "tail", F.col("p.pass").alias("pass"), F.col("p.take").alias("take"),
    ).filter("take > 0")
    each = each.withColumn("key", _bits(F.lit(seed), F.col("rank"), F.col("pass")))
    each = each.withColumn("short_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.col("key"), inverse=True))
    full = F.ceil(F.col("take") / block_words).cast("long")
    with_short = F.ceil((F.col("take") + block_words - F.col("tail")) / block_words).cast("long")
    slots = F.when(F.col("short_at") >= full, full).otherwise(with_short)
    return each.withColumn("slots", F.least(slots, F.col("blocks")))


def _chunks(df: DataFrame, count: str, size: int) -> DataFrame:
    """A row per number below ``count``; long runs are cut and dealt out before they unfold."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(size).cast("long")))
    cut = df.filter(F.col(count) > 0).withColumn("_from", starts)
    cut = cut.repartition("rank", "pass", "_from")
    upto = F.least(F.col("_from") + size, F.col(count)) - 1
    return cut.withColumn("number", F.explode(F.sequence(F.col("_from"), upto))).drop("_from")


def shard_counts(plan: DataFrame, shards: int, seed: int, chunk: int = 50_000) -> DataFrame:
    """(shard, rank, pass, n): the multinomial draws, counted per shard, source and pass."""
    draws = _chunks(plan.select("rank", "pass", "slots"), "slots", chunk)
    shard = F.pmod(_bits(F.lit(seed), F.lit("shard"), F.col("rank"), F.col("pass"), F.col("number")), F.lit(shards))
    return draws.groupBy(shard.alias("shard"), "rank", "pass").agg(F.count("*").alias("n"))


def slots_of(plan: DataFrame, counts: DataFrame, block_words: int, tasks: int = 1) -> DataFrame:
    """(shard, source, rank, pass, slot, block, take): every slot with its block and words to take.

    Counts are small and slots many: the counts are dealt to ``tasks`` before they unfold.
    """
    by_shard = Window.partitionBy("rank", "pass").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("n").over(by_shard), F.lit(0)))
    opened = placed.join(plan.hint("merge"), ["rank", "pass"]).repartition(tasks, "rank", "pass", "shard")
    opened = opened.withColumn("slot", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)))
    start = F.col("slot") * block_words - F.when(
        F.col("slot") > F.col("short_at"), block_words - F.col("tail")
    ).otherwise(F.lit(0))
    length = F.when(F.col("slot") == F.col("short_at"), F.col("tail")).otherwise(F.lit(block_words).cast("long"))
    return opened.select(
        "shard", "source", "rank", "pass", "slot",
        permuted(F.col("slot"), F.col("blocks"), F.col("key")).alias("block"),
        F.least(length, F.col("take") - start).alias("take"),
    ).filter("take > 0")


def mix(
    docs: DataFrame, block_words: int = 256, shard_slots: int = 4096, seed: int = 17,
    weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, bucket_docs: int = 5000, task_slots: int = 50_000,
    columns: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The documents with size, source_size, target, taken and pieces, and the mix's slots.

    ``pieces`` are (pass, block, shard, slot, start, stop): words start to stop, exclusive, of
    the document, at a slot of a shard.
    """
    docs, renamed, back = aside(docs)
    carry = [renamed.get(c, c) for c in (columns or docs.columns) if c.lower() not in RESULTS]
    key = next((c for c in ("doc_id",) if c in docs.columns), None)
    rank, start, bucket, offset = (fresh(docs, n) for n in ("rank", "start", "bucket", "offset"))
    keyed = [c for c in ("source", key) if c and c not in carry]
    sized = docs.select(*carry, *keyed, F.size(plain_words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias(offset))
    sized = stored(sized, "mix-sizes")
    total = sized.agg(F.count("*").alias("n")).first()["n"]
    buckets = max(1, -(-total // bucket_docs))

    order = [F.xxhash64(F.lit(seed), *([F.col(key)] if key else []), F.col(offset)), *([F.col(key)] if key else []), F.col(offset), F.col("size")]
    dealt = sized.withColumn(bucket, F.pmod(order[0], F.lit(buckets)))
    sums = dealt.groupBy("source", bucket).agg(F.sum("size").alias("words"))
    by_bucket = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("_s"), F.col(bucket).alias("_b"),
        F.coalesce(F.sum("words").over(by_bucket), F.lit(0)).alias("_before"),
    )
    goals = stored(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, percent), "mix-goals")
    plan = stored(plan_of(goals, block_words, seed), "mix-plan")
    slot_total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-slot_total // shard_slots))
    slots = slots_of(plan, shard_counts(plan, shards, seed), block_words, max(1, -(-slot_total // task_slots)))

    inside = Window.partitionBy("source", bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col(bucket) == F.col("_b")))
    placed = placed.withColumn(start, F.col("_before") + F.col("_in")).drop("_s", "_b", "_before", "_in", bucket, offset)
    ranks = goals.select(F.col("source").alias("_s"), F.col("rank").alias(rank), "source_size", "target")
    placed = stored(placed.join(ranks, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-placed")

    first, last = F.floor(F.col(start) / block_words), F.floor((F.col(start) + F.col("size") - 1) / block_words)
    pieces = placed.filter("size > 0").select(
        F.col(rank).alias("rank"), F.col(start).alias("start"), "size", F.explode(F.sequence(first, last)).alias("block")
    )
    takes = slots.groupBy("rank", "block").agg(  # at most one a pass
        F.collect_list(F.struct("pass", "shard", "slot", "take")).alias("takes")
    )
    at = F.col("block") * block_words
    drawn = F.filter(F.transform("takes", lambda t: F.struct(
        t["pass"].alias("pass"), F.col("block").alias("block"), t["shard"].alias("shard"), t["slot"].alias("slot"),
        (F.greatest(F.col("start"), at) - F.col("start")).alias("start"),
        (F.least(F.col("start") + F.col("size"), at + t["take"]) - F.col("start")).alias("stop"),
    )), lambda p: p["stop"] > p["start"])
    taken = pieces.join(takes.hint("merge"), ["rank", "block"]).groupBy("rank", "start").agg(
        F.sort_array(F.flatten(F.collect_list(drawn))).alias("pieces")
    )
    taken = taken.select(F.col("rank").alias("_r"), F.col("start").alias("_at"), "pieces", F.aggregate(
        "pieces", F.lit(0).cast("long"), lambda acc, p: acc + p["stop"] - p["start"]).alias("taken"))
    whole = placed.join(
        taken.hint("merge"), (F.col(rank) == F.col("_r")) & (F.col(start) == F.col("_at")) & (F.col("size") > 0), "left"
    ).withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    return back(whole.select(*carry, *RESULTS)), slots


def _ranges(pieces: Column) -> Column:
    """(pass, start, stop): pieces in order, adjoining ones of a pass as one."""
    def step(acc: Column, p: Column) -> Column:
        one = F.struct(p["pass"].alias("pass"), p["start"].alias("start"), p["stop"].alias("stop"))
        def put(last: Column) -> Column:
            longer = F.struct(p["pass"].alias("pass"), last["start"].alias("start"), p["stop"].alias("stop"))
            joins = (last["pass"] == p["pass"]) & (last["stop"] == p["start"])
            return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(one)))
        return F.when(F.size(acc) == 0, F.array(one)).otherwise(let(F.get(acc, F.size(acc) - 1), put))

    return F.aggregate(pieces, F.array().cast("array<struct<pass:int,start:bigint,stop:bigint>>"), step)


def _words_of(parts: Column, r: Column) -> Column:
    """The words of a range, as they were spelt and spaced."""
    own = F.slice(parts, (r["start"] + 1).cast("int"), (r["stop"] - r["start"]).cast("int"))
    return F.ltrim(F.array_join(own, ""), F.lit(" \t\n\x0b\x0c\r"))


def drawn_text(text: Column, size: Column, pieces: Column) -> Column:
    """The words that the pieces take, ranges apart from each other in lines of their own."""
    def made(ranges: Column) -> Column:
        whole = F.forall(ranges, lambda r: r["stop"] - r["start"] == size)
        cut = let(F.split(text, BEHIND_WORD, -1), lambda parts: F.array_join(F.transform(ranges, lambda r: _words_of(parts, r)), "\n"))
        return F.when(whole, F.array_join(F.array_repeat(text, F.size(ranges)), "\n")).otherwise(cut)

    return let(_ranges(pieces), made)


def _mixed(docs: DataFrame) -> DataFrame:
    """Every document of the mix with its columns, whole text and pieces.

    The mix runs over sizes and row hashes; texts move once, to meet its rows. Equal rows
    share a hash; then one of their copies stands for all, and each keeps its own words.
    """
    docs, _, back = aside(docs)
    names = [c for c in docs.columns if c.lower() not in RESULTS]
    row = fresh(docs, "row")
    # 128 bits, from two seeds
    hashed = docs.withColumn(row, F.concat_ws("/", F.xxhash64(*names).cast("string"), F.xxhash64(F.lit("row"), *names).cast("string")))
    keys = [c for c in ("doc_id", "source") if c in names]
    mixed, _ = mix(hashed.select(*keys, "text", row), columns=[*keys, row])
    mixed = stored(mixed.filter("taken > 0").select(F.col(row).alias("_row"), *RESULTS), "mixed")
    texts = hashed.select(*names, row)
    if not mixed.groupBy("_row").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        texts = texts.dropDuplicates([row])
    return back(mixed.join(texts, F.col("_row") == F.col(row)).select(*names, *RESULTS))


def mixing_stage(docs: DataFrame) -> DataFrame:
    """The documents of the mix, one row each, with the words drawn of them as ``text``.

    A document of which words are drawn twice holds them twice; ``n_chars`` follows the text.
    """
    mixed = _mixed(docs)
    out = mixed.withColumn("text", drawn_text(F.col("text"), F.col("size"), F.col("pieces")))
    if "n_chars" in mixed.columns:
        whole = (F.size("pieces") > 0) & (F.size(_ranges(F.col("pieces"))) == 1) & (F.col("taken") == F.col("size"))
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out


def mixed_blocks(docs: DataFrame) -> DataFrame:
    """(shard, slot, source, pass, block, doc_id, start, stop, text): the mix's pieces by place.

    The pieces of a slot, in order of their rows' places in the source, are its block.
    """
    keys = [c for c in ("source", "doc_id") if c in docs.columns]
    texts = let(F.split("text", BEHIND_WORD, -1), lambda parts: F.transform("pieces", lambda p: F.struct(
        *(p[c].alias(c) for c in ("shard", "slot", "pass", "block", "start", "stop")), _words_of(parts, p).alias("text"))))
    return _mixed(docs).select(*keys, F.explode(texts).alias("_p")).select(
        "_p.shard", "_p.slot", *keys, "_p.pass", "_p.block", "_p.start", "_p.stop", "_p.text")
