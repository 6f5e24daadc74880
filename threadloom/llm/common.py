"""Small helpers the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.runtime import scratch_path

#: Upper-case ASCII becomes lower case, every other ASCII byte outside 0-9 a-z a blank.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else 0x20
    for b in range(256)
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """The array of ``combine`` over each value and all before it.

    In runs of about the square root of the length, so that no long array is copied per value.
    """
    def folded(run: Column) -> Column:
        zero = F.struct(F.lit(None).cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            return let(F.coalesce(combine(acc["at"], x), x), lambda now: F.struct(
                now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out")))

        return F.aggregate(run, zero, step, lambda acc: acc["out"])

    def joined(runs: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast(kind)), folded(F.transform(runs, lambda r: F.element_at(r, -1))))
        return F.flatten(F.zip_with(F.slice(before, 1, F.size(runs)), runs, lambda ahead, run: F.transform(
            run, lambda x: F.coalesce(combine(ahead, x), x))))

    def cut(known: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(known))).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(1), F.greatest(F.size(known), F.lit(1)), width)
        return let(F.transform(starts, lambda at: folded(F.slice(known, at, width))), joined)

    return let(values, lambda known: F.when(F.size(known) > 0, cut(known)).otherwise(F.array().cast(f"array<{kind}>")))


def plain_words(text: Column) -> Column:
    """The words between ASCII white space; none for a null text.

    Other white space becomes a blank first: splitting at a blank needs no pattern.
    """
    text = F.coalesce(text, F.lit(""))
    for sign in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(sign), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def folded_words(text: str | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table once into the shared folder and reads it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def aside(df: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``df`` without names that begin with ``_``, which operators use inside; the new names, and the way back."""
    names: dict[str, str] = {}
    for c in df.columns:
        if c.startswith("_"):
            names[c] = fresh(df.withColumnsRenamed(names), "aside" + c)
    return df.withColumnsRenamed(names), names, lambda out: out.withColumnsRenamed({new: old for old, new in names.items()})


def joined_by_weight(rows: DataFrame, lookup: DataFrame, key: str, weight: str, share: int = 1000) -> DataFrame:
    """Inner join with a table of one row per key and the number of ``rows`` each key has.

    A key may hold any share of the rows: those above one in ``share`` of all, fewer than
    ``share`` keys by their definition, are broadcast, and the rest is shuffled.
    """
    total = lookup.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("total")).first()["total"]
    heavy = F.col(weight).cast("decimal(38,0)") * share > total
    often = F.broadcast(lookup.filter(heavy).drop(weight))
    seldom = rows.join(often.select(key), key, "left_anti").join(lookup.filter(~heavy).drop(weight), key)
    return rows.join(often, key).unionByName(seldom)


def documents(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
