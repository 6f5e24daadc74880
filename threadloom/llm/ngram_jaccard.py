"""N-gram Jaccard join: all pairs of documents whose word shingles overlap by 0.8 or more.

Texts with the same set of five-word shingles form one class, so copies cost nothing
further. Classes get MinHash values; 25 bands of five of them bring similar classes into
common groups, whose least member stands for the group, and the connected groups are found
by rounds of star joins. They only say where classes meet: a small group in one task, a larger one in
blocks, where a class goes to its own and to those that hold a class it shares a band with. Of two
classes only such are compared that share a band: MinHash values are
compared sixteen at a time, and a pair is dropped as soon as the posterior probability that its
similarity reaches the threshold, under a uniform prior, falls below ``TOLERANCE``. The rest
is verified exactly on the shingles. Links are counted, not listed: a block reports, per
class, the documents linked and the least class it is connected with.

A pair of similarity s is missed by all bands with probability (1 - s^5)^25: 5e-5 at 0.8,
2e-7 at 0.86. Shingles are compared by 64-bit hashes, rows by 128 bits of id and text.

A text of one to four words has one shingle, all of its words. Null texts and texts without
words have none and link with nothing. Repeated rows are copies. Null ids take part; a class of
null ids only has a null id. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import FOLD, fresh, mix64, stored

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
HASHES = 128
STEP = 16
TOLERANCE = 1e-6
BLOCK_CLASSES, BLOCK_BYTES = 1024, 16_000_000
BATCH_BYTES = 2_000_000
PART_ROWS = 500

_CHAIN = mix64(np.arange(1, 3, dtype=np.uint64)) | np.uint64(1)
_SEEDS = (mix64(np.arange(7_000, 7_000 + HASHES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_MULTIPLIERS = (mix64(np.arange(9_000, 9_000 + HASHES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash per word of folded text, all words at once."""
    array = np.frombuffer(data, np.uint8)
    inside = array != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = stops - starts
    letters = array[inside].astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        terms = mix64(letters + (place.astype(np.uint64) << np.uint64(8)))
        return mix64(np.add.reduceat(terms, first) ^ (sizes.astype(np.uint64) << np.uint64(48)))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = _word_hashes((text or "").encode("utf-8", "replace").translate(FOLD))
    n = len(words)
    if not n:
        return words
    width = min(SHINGLE, n)
    out = np.zeros(n - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = mix64(out * _CHAIN[0] + words[k:n - width + 1 + k])
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """The least of every seeded hash over the shingles, 32 bits each."""
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    folded = (found >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(folded), 512):
        values = (folded[start:start + 512] ^ _SEEDS[:, None]) * _MULTIPLIERS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values[:BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mix64(key * _CHAIN[1] + rows[:, k])
    return key.view(np.int64)


def set_key(found: np.ndarray) -> bytes:
    return blake2b(found.tobytes(), digest_size=16).digest()


@lru_cache(maxsize=4)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """Per step: the fewest equal values at which the posterior is not below ``tolerance``.

    With a uniform prior, P(S >= t | m of n) is the binomial distribution function of m
    over n + 1 trials of probability t.
    """
    needed = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        needed.append(m)
    return tuple(needed)


def band_sharers(left: range, right: range, signatures: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``left``, the later rows of ``right`` that have one of its bands.

    Where its bands have more rows together than ``right`` has, all of these are given.
    """
    keys = np.stack([band_keys(s) for s in signatures]) if len(signatures) else np.empty((0, BANDS), np.int64)
    order = right.start + np.argsort(keys[right.start:right.stop], axis=0, kind="stable")
    ordered = np.take_along_axis(keys, order, axis=0)
    own = keys[left.start:left.stop]
    low = np.stack([np.searchsorted(ordered[:, b], own[:, b], "left") for b in range(BANDS)], axis=1)
    high = np.stack([np.searchsorted(ordered[:, b], own[:, b], "right") for b in range(BANDS)], axis=1)
    many = (high - low).sum(axis=1)
    for n, i in enumerate(left):
        first = max(right.start, i + 1)
        if many[n] >= len(right):
            yield i, np.arange(first, right.stop)
            continue
        found = np.unique(np.concatenate([order[low[n, b]:high[n, b], b] for b in range(BANDS)]))
        yield i, found[found >= first]


def similar_pairs(
    left: range, right: range, signatures: np.ndarray, sets: list[np.ndarray], threshold: float
) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``left``, the later rows of ``right`` that share a band and reach the threshold."""
    needed = least_matches(threshold, TOLERANCE)
    sizes = np.array([len(s) for s in sets], np.int64)
    numbers = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.empty(0, np.int64)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    marked = np.zeros(int(numbers.max()) + 1 if len(numbers) else 0, bool)
    for i, others in band_sharers(left, right, signatures):
        small, large = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
        others = others[small >= threshold * large - 1e-9]
        equal = np.zeros(len(others), np.int64)
        for step, least in enumerate(needed):
            if not len(others):
                break
            part = slice(step * STEP, (step + 1) * STEP)
            equal += (signatures[others, part] == signatures[i, part]).sum(axis=1)
            stay = equal >= least
            others, equal = others[stay], equal[stay]
        if not len(others):
            continue
        own = numbers[starts[i]:stops[i]]
        marked[own] = True
        common = np.array([np.count_nonzero(marked[numbers[starts[j]:stops[j]]]) for j in others])
        marked[own] = False
        exact = common >= threshold * (sizes[i] + sizes[others] - common) - 1e-9
        if exact.any():
            yield i, others[exact]


SIGNED = "row_key binary, doc_id bigint, set_key binary, n int, bands array<bigint>"


def _small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches in parts, so that the shingles of few texts are held at once."""
    for batch in batches:
        for start in range(0, len(batch), PART_ROWS):
            yield batch.iloc[start:start + PART_ROWS]


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _small(batches):
        keys, counts, bands = [], [], []
        for text in batch["text"]:
            found = shingles(text)
            counts.append(len(found))
            keys.append(set_key(found) if len(found) else None)
            bands.append(band_keys(signature(found)) if len(found) else None)
        yield pd.DataFrame({
            "row_key": batch["row_key"].to_numpy(), "doc_id": batch["doc_id"].to_numpy(), "set_key": keys, "n": counts, "bands": bands,
        })


def _shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _small(batches):
        sets = [shingles(t) for t in batch["text"]]
        yield batch.drop(columns="text").assign(
            shingles=[s.tobytes() for s in sets], signature=[signature(s).tobytes() for s in sets]
        )


def _root(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _links_of(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Links within one group of whole connected groups, or between two blocks of one."""
    out = []
    for (_, i, j), rows in group.groupby(["comp", "i", "j"], sort=False):
        if i != j and rows["side"].nunique() < 2:
            continue  # one of the two blocks is empty
        rows = rows.sort_values(["side", "set_key"], kind="stable")
        keys, weights, sides = rows["set_key"].tolist(), rows["weight"].to_numpy(), rows["side"].to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in rows["shingles"]]
        signatures = np.stack([np.frombuffer(b, np.uint32) for b in rows["signature"]])
        first = int((sides == 0).sum())
        left, right = range(first), range(first) if i == j else range(first, len(keys))
        links = np.zeros(len(keys), np.int64)
        parent = {i: i for i in range(len(keys))}
        for i, others in similar_pairs(left, right, signatures, sets, THRESHOLD):
            links[i] += weights[others].sum()
            links[others] += weights[i]
            for j in others.tolist():
                a, b = _root(parent, i), _root(parent, j)
                parent[max(a, b)] = min(a, b)
        least: dict[int, bytes] = {}
        for i in range(len(keys)):
            r = _root(parent, i)
            least[r] = min(least.get(r, keys[i]), keys[i])
        for i in range(len(keys)):
            out.append((keys[i], int(links[i]), least[_root(parent, i)], bool(rows["blocks"].iat[0] == 1)))
    return pd.DataFrame(out, columns=["set_key", "links", "root", "whole"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, comp): the least node connected with each node of an edge list.

    Rounds of large and small stars; every round is written to the shared folder.
    """
    current = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "stars")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(current)
    while before[0]:
        # large star: every larger neighbour of u goes to the least neighbour of u
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours go to the least of them
        large = large.filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        current = stored(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "stars")
        after = state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def row_key() -> Column:
    """128 bits that stand for a row's id and text; a null is told from an empty text."""
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    return F.unhex(F.md5(F.concat(number, F.when(F.col("text").isNull(), "|").otherwise(F.concat(F.lit("="), "text")))))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(row_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, comp, class_id, n_links, set_size), one row per row of ``docs``.

    ``class_id`` is the least id among the documents connected by links, ``n_links`` the
    documents linked with this one, copies included. ``row_key`` hashes id and text. ``comp`` names the connected documents
    also where ids are null or repeated; it is null for a document without links.
    """
    signed = stored(_keyed(docs).mapInPandas(_signed, SIGNED), "signed")
    rows = signed.select("row_key", "doc_id", "set_key", "n")
    classes = stored(
        signed.filter("n > 0").groupBy("set_key").agg(
            F.count("*").alias("weight"), F.min("doc_id").alias("least_id"), F.min("row_key").alias("row_key"),
            F.max("n").alias("n"), F.first("bands").alias("bands"),
        ), "classes",
    )
    banded = classes.select("set_key", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("set_key").alias("hub"), F.count("*").alias("many")).filter("many > 1")
    edges = banded.join(hubs, "band").select("set_key", "hub").filter("set_key <> hub").distinct()
    groups = stored(components(edges, "set_key", "hub").withColumnRenamed("node", "set_key"), "groups")

    sized = groups.join(classes.select("set_key", "weight", "row_key", "n"), "set_key")
    totals = sized.groupBy("comp").agg(F.count("*").alias("members"), F.sum(F.col("n") * 8 + 600).alias("bytes"))
    totals = totals.select("comp", "bytes", F.greatest(
        F.ceil(F.col("members") / BLOCK_CLASSES), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    totals = stored(totals, "totals")
    held = totals.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    packs = max(1, -(-held // BATCH_BYTES))
    members = sized.join(totals.drop("bytes"), "comp").select("row_key", "set_key", "comp", "weight", "blocks")
    own = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    # in a group of several blocks, the blocks that hold a class sharing a band with this one
    crowded = banded.join(members.filter("blocks > 1").select("set_key", own.alias("own")), "set_key")
    present = crowded.groupBy("band").agg(F.collect_set("own").alias("there")).filter(F.size("there") > 1)
    met = crowded.join(present, "band").groupBy("set_key").agg(F.array_distinct(F.flatten(F.collect_set("there"))).alias("there"))
    texts = _keyed(docs).drop("doc_id").join(members.join(met, "set_key", "left"), "row_key").dropDuplicates(["set_key"])
    schema = "row_key binary, set_key binary, comp binary, weight bigint, blocks int, there array<int>, shingles binary, signature binary"
    ready = texts.mapInPandas(_shingled, schema).drop("row_key")

    others = F.array_union(F.array(own), F.coalesce("there", F.array().cast("array<int>")))
    low = F.transform(others, lambda other: F.struct(
        F.least(own, other).alias("i"), F.greatest(own, other).alias("j"),
        F.when(own <= other, 0).otherwise(1).alias("side"),
    ))
    dealt = ready.withColumn("pair", F.explode(low)).withColumn(
        "piece", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(packs)))
        .otherwise(F.xxhash64("comp", "pair.i", "pair.j")),
    )
    linked = dealt.select("piece", "set_key", "comp", "weight", "blocks", "pair.i", "pair.j", "pair.side", "shingles", "signature")
    schema = "set_key binary, links bigint, root binary, whole boolean"
    found = stored(linked.groupBy("piece").applyInPandas(_links_of, schema), "links")
    links = found.groupBy("set_key").agg(F.sum("links").alias("links"))
    # a group in one block has its roots; blocks of a larger one are connected over their roots
    split = components(found.filter("not whole"), "set_key", "root").withColumnRenamed("node", "set_key")
    roots = split.unionByName(found.filter("whole and set_key <> root").select("set_key", F.col("root").alias("comp")))

    joined = classes.select("set_key", "weight", "least_id").join(links, "set_key", "left").join(roots, "set_key", "left")
    joined = joined.withColumn("comp", F.coalesce("comp", "set_key")).filter("weight > 1 or links > 0")
    named = joined.groupBy("comp").agg(F.min("least_id").alias("class_id"))
    answers = joined.join(named, "comp").select(
        F.col("set_key").alias("_set"), "comp", "class_id",
        (F.col("weight") - 1 + F.coalesce("links", F.lit(0).cast("long"))).alias("n_links"),
    )
    return rows.join(answers, F.col("set_key") == F.col("_set"), "left").select(
        "doc_id", "row_key", "comp", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.col("n").alias("set_size"),
    )


def jaccard_stage(docs: DataFrame) -> DataFrame:
    """One document of each connected group, the one with the least id; others stay.

    Of repeated rows one stays. Documents that share nothing, also those without words, stay.
    """
    joined = stored(jaccard_join(docs), "jaccard")
    going = joined.filter("doc_id <> class_id or (doc_id is null and class_id is not null)")
    row, first = fresh(docs, "row"), fresh(docs, "first_row")
    kept = docs.withColumn(row, row_key()).join(
        going.select(F.col("row_key").alias(row)).distinct(), row, "left_anti"
    )
    # rows with equal ids that are linked: the one with the least key stays
    ties = joined.filter("n_links > 0 and doc_id <=> class_id").groupBy("comp").agg(
        F.count("*").alias("rows"), F.min("row_key").alias("first")
    ).filter("rows > 1")
    ties = stored(ties, "ties")
    if ties.isEmpty():
        return kept.select(*docs.columns)
    in_tie = joined.filter("n_links > 0 and doc_id <=> class_id").join(ties.select("comp", "first"), "comp")
    marks = in_tie.select(F.col("row_key").alias(row), (F.col("row_key") == F.col("first")).alias(first)).distinct()
    marked = kept.join(marks, row, "left")
    single = marked.filter(F.col(first)).dropDuplicates([row])
    return marked.filter(F.col(first).isNull()).unionByName(single).select(*docs.columns)
