"""Quality rules with thresholds adapted to each language and source.

Every document is measured inside its row. The measures of all documents go into
mergeable quantile sketches: counts per rounded value (five significant bits), kept for
each (lang, source, measure). Sketches merge by adding counts, so those of a language, and
of everything, are sums of the sources' sketches. A threshold is the upper quartile plus
three quartile distances of the finest group with enough rows, and never beyond twice
that distance in its language, so that a source of junk alone does not pass itself.
The thresholds then join the measured documents.

Null or empty texts have no words and fail the base rules. Null languages and sources form
groups of their own. Repeated rows are judged alike, an empty table gives an empty one, and
other columns stay. Windows of five words are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import aside, let, plain_words, stored

#: Fixed values of the base rules.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals"]

#: Ratio: numerator, denominator, least quartile distance in thousandths, counts forgiven.
RATIOS = {
    "symbols": ("n_symbols", "n_words", 30, 4),
    "dup_lines": ("n_dup_lines", "n_lines", 60, 2),
    "repeats": ("n_repeat_words", "n_words", 30, 10),
    "capitals": ("n_capitals", "word_chars", 30, 30),
}
#: Mean word length has two sides; its slack shrinks with the root of the word count.
LENGTH_SPREAD, LENGTH_SLACK = 300, 9000
FENCE = 3


def _repeat_words(grams: Column) -> Column:
    """Words inside windows whose hash occurs twice or more, given all window hashes."""
    def covered(places: Column) -> Column:
        zero = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            places, zero,
            lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["at"])).alias("n")),
            lambda acc: acc["n"],
        )

    def twice(pairs: Column) -> Column:
        same = F.filter(
            pairs,
            lambda e, i: (F.get(pairs, i - 1)["h"] == e["h"]) | (F.get(pairs, i + 1)["h"] == e["h"]),
        )
        return F.sort_array(F.transform(same, lambda e: e["p"]))

    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    heavy = let(let(pairs, twice), covered)
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(heavy)


def _joined(a, b) -> Column:
    """Hashes of runs from hashes of their parts; the surplus end is cut off by the caller."""
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def measure(docs: DataFrame) -> DataFrame:
    """Adds the measures. Columns of ``docs`` with the same names are replaced."""
    docs = docs.drop(*MEASURES)
    text = F.coalesce(F.col("text"), F.lit(""))
    stage = docs.withColumns({
        "_words": plain_words(F.col("text")),
        "_lines": F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    })
    stage = stage.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    grams = let(
        _joined("_hashes", F.slice("_hashes", F.lit(2), F.size("_hashes"))),
        lambda two: _joined(_joined(two, F.slice(two, F.lit(3), F.size(two))), F.slice("_hashes", F.lit(5), F.size("_hashes"))),
    )
    stage = stage.withColumn(
        "_grams", F.slice(grams, F.lit(1), F.greatest(F.size("_hashes") - (WINDOW - 1), F.lit(0)))
    ).withColumn("_marks", F.regexp_replace(text, r"[^A-Z#*$%&|<>]+", ""))
    symbols = F.length("_marks") - F.length(F.regexp_replace("_marks", SYMBOLS, ""))
    long = lambda c: c.cast("long")
    return stage.withColumns({
        "n_words": long(F.size("_words")),
        "word_chars": long(F.length(F.array_join("_words", ""))),
        "n_symbols": long(symbols),
        "n_lines": long(F.size("_lines")),
        "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
        "n_repeat_words": _repeat_words(F.col("_grams")),
        "n_capitals": long(F.length("_marks") - symbols),
    }).drop("_words", "_lines", "_hashes", "_grams", "_marks")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )


def rounded(value: Column) -> Column:
    """A count with its five leading bits after the first kept: the sketch's key."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, value, n): one mergeable quantile sketch per group."""
    thousandths = lambda a, b: F.floor(1000 * F.col(a) / F.col(b)).cast("long")
    values = [F.struct(F.lit("length").alias("m"), thousandths("word_chars", "n_words").alias("v"))]
    values += [
        F.struct(F.lit(name).alias("m"), thousandths(top, bottom).alias("v"))
        for name, (top, bottom, _, _) in RATIOS.items()
    ]
    rows = measured.filter(F.col("n_words") > 0).select("lang", "source", F.explode(F.array(*values)).alias("x"))
    return rows.groupBy(
        "lang", "source", F.col("x.m").alias("measure"), rounded(F.col("x.v")).alias("value")
    ).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Merges sketches up to ``keys`` and reads rows, lower and upper quartile from each."""
    merged = sketch.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.select(
        "*", F.sum("n").over(group).alias("total"),
        F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
    )
    first = lambda part: F.min(F.when(4 * F.col("upto") >= part * F.col("total"), F.col("value")))
    return ranked.groupBy(*keys, "measure").agg(
        F.max("total").alias("rows"), first(1).alias("low"), first(3).alias("high")
    )


def thresholds(sketch: DataFrame, least_rows: int = 200) -> DataFrame:
    """One row per (lang, source) with ``length_low`` and, per measure, ``<measure>_high``.

    A group with fewer than ``least_rows`` documents uses its language's quartiles, and a
    language with fewer those of all documents.
    """
    floors = {"length": LENGTH_SPREAD} | {name: spread for name, (_, _, spread, _) in RATIOS.items()}
    floor = F.create_map(*[F.lit(x) for pair in floors.items() for x in pair])[F.col("measure")]

    def level(keys: list[str], tag: str) -> DataFrame:
        q = quartiles(sketch, keys)
        wide = F.greatest(F.col("high") - F.col("low"), floor)
        return q.select(*keys, "measure", *(
            c.alias(f"{tag}_{n}") for n, c in (("rows", F.col("rows")), ("low", F.col("low")), ("high", F.col("high")), ("wide", wide))
        ))

    fine, lang, all_rows = level(["lang", "source"], "s"), level(["lang"], "l"), level([], "a")
    lang = lang.withColumnsRenamed({"lang": "lang_", "measure": "measure_"})
    all_rows = all_rows.withColumnRenamed("measure", "measure__")
    joined = fine.join(
        lang, F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("measure") == F.col("measure_")), "left"
    ).join(all_rows, F.col("measure") == F.col("measure__"), "left")
    big_l, big_s = F.col("l_rows") >= least_rows, F.col("s_rows") >= least_rows
    pick = lambda n: F.when(big_l, F.col(f"l_{n}")).otherwise(F.col(f"a_{n}"))
    outer_high, outer_low = pick("high") + 2 * FENCE * pick("wide"), pick("low") - 2 * FENCE * pick("wide")
    own = lambda n: F.when(big_s, F.col(f"s_{n}")).otherwise(pick(n))
    fenced = joined.select(
        "lang", "source", "measure",
        F.least(own("high") + FENCE * own("wide"), outer_high).alias("high"),
        F.greatest(own("low") - FENCE * own("wide"), outer_low).alias("low"),
    )
    of = lambda name, c: F.max(F.when(F.col("measure") == name, F.col(c)))
    return fenced.groupBy("lang", "source").agg(
        of("length", "low").alias("length_low"),
        *(of(name, "high").alias(f"{name}_high") for name in ("length", *RATIOS)),
    )


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to measured documents."""
    limits = limits.withColumnsRenamed({c: f"_{c}" for c in limits.columns})
    joined = measured.drop("base_failed", "kept").join(
        limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left"
    )
    bad = [
        1000 * F.col(top) > F.col(f"_{name}_high") * F.col(bottom) + 1000 * forgiven
        for name, (top, bottom, _, forgiven) in RATIOS.items()
    ]
    for limit, sign in (("_length_high", 1), ("_length_low", -1)):
        over = sign * (1000 * F.col("word_chars") - F.col(limit) * F.col("n_words"))
        bad.append((over > 0) & (over.cast("double") * over > F.lit(float(LENGTH_SLACK) ** 2) * F.col("n_words")))
    wrong = bad[0]
    for b in bad[1:]:
        wrong = wrong | b
    return joined.withColumns({
        "base_failed": base_failed(),
        "kept": ~(base_failed() | F.coalesce(wrong, F.lit(False))),
    }).drop(*limits.columns)


def quality_rules(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Documents with measures, ``base_failed`` and ``kept``.

    ``columns`` names the input columns to carry; leaving ``text`` out keeps the stored
    intermediate table small.
    """
    docs, renamed, back = aside(docs)
    measured = measure(docs)
    carry = [renamed.get(c, c) for c in (columns or docs.columns) if c not in MEASURES]
    keys = [c for c in ("lang", "source") if c not in carry]
    measured = stored(measured.select(*carry, *keys, *MEASURES), "quality")
    limits = stored(thresholds(sketches(measured)), "quality-limits")
    return back(judge(measured, limits).drop(*keys))


def quality_stage(docs: DataFrame) -> DataFrame:
    """The documents kept, with their own columns."""
    return quality_rules(docs).filter("kept").select(*docs.columns)
