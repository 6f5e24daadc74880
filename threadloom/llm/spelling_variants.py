"""Spelling variants: words one edit apart, found by search schemes over FM-indexes.

Of two words that differ by one edit, the shorter (or equally long) one, cut in the middle, has
a half that the other holds unchanged at the same end. A word is therefore searched twice: its second half
is matched exactly in an index of the words and extended to the left, its first half in
an index of the reversed words and extended the same way, across the other half with one
error. Both indexes hold the words between delimiters; a match is an interval of suffix ranks.
Where an interval leaves several symbols, only these are followed.

Words meet by their exact half: each goes to the shards of its halves, and a shard, of bounded
size, gets its own index. A half whose words have more than ``BLOCK`` letters together is cut
into blocks, and each block of words searched in the index of each. A shard returns one row
per word: how many it found and the most frequent. Forms are followed by doubling the steps,
in rounds over tables.

Null or empty texts have no words; a null id counts as empty text. Copies and repeated rows
count each. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import stored

MIN_LENGTH = 5
MIN_COUNT = 3
#: One in so many of a document's distinct words is misspelt on purpose.
SLIP = 97
#: A form is at least so many times as frequent.
RATIO = 2
#: Letters of the words of a shard, about; letters of one half's words that one index holds, about.
SHARD, BLOCK = 400_000, 800_000
#: Words counted before a task hands them on; queries searched at a time.
FLUSH, CHUNK = 500_000, 4096

RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}")
LOWER = {i: i + 32 for i in range(65, 91)}


# --- counting -----------------------------------------------------------------------

def slipped(word: str, start: int) -> str:
    """``word`` less one letter where its hash says so; ``start`` is the hash of what precedes it."""
    h = crc32(word.encode(), start)
    if h % SLIP:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def _batch(counts: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, int] = {}
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            start = crc32(f"{doc_id or ''}:".encode())
            found: dict[str, int] = {}
            for run in RUN.findall(text or ""):
                found[run] = found.get(run, 0) + 1
            for run, n in found.items():
                word = slipped(run.lower() if run.isascii() else run.translate(LOWER), start)
                if len(word) >= MIN_LENGTH:
                    counts[word] = counts.get(word, 0) + n
            if len(counts) > FLUSH:
                yield _batch(counts)
                counts = {}
    yield _batch(counts)


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts, slips applied, that occur ``min_count`` times or more."""
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    counted = texts.mapInArrow(_counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# --- the index ----------------------------------------------------------------------

class Index:
    """An FM-index of words between delimiters: a wavelet matrix over the transformed text.

    Symbols are numbers from 1; 0 is the delimiter. ``words`` are distinct.
    """

    def __init__(self, words: list[np.ndarray], symbols: int):
        self.lengths = np.array([len(w) for w in words])
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        text = np.zeros(int((self.lengths + 1).sum()), np.int64)
        for start, word in zip(self.starts.tolist(), words):
            text[start:start + len(word)] = word
        self.size = len(text)
        self.suffixes = _sorted_rotations(text, symbols)
        turned = text[self.suffixes - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 1))))
        self.levels = list(range(max(1, symbols.bit_length()) - 1, -1, -1))
        self.zeros: list[np.ndarray] = []
        for level in self.levels:
            bit = (turned >> level) & 1 == 1
            self.zeros.append(np.concatenate(([0], np.cumsum(~bit))))
            turned = np.concatenate((turned[~bit], turned[bit]))
        first, _ = self._down(np.zeros(symbols + 1, np.int64), np.zeros(symbols + 1, np.int64), np.arange(symbols + 1))
        self.shift = self.before[:-1] - first

    def _down(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for level, zeros in zip(self.levels, self.zeros):
            one = (symbol >> level) & 1 == 1
            z_low, z_high, all_zeros = zeros[low], zeros[high], zeros[-1]
            low = np.where(one, all_zeros + low - z_low, z_low)
            high = np.where(one, all_zeros + high - z_high, z_high)
        return low, high

    def extended(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of what was matched with ``symbol`` in front."""
        low, high = self._down(low, high, symbol)
        return low + self.shift[symbol], high + self.shift[symbol]

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All symbols that stand in front of a match: (match, symbol, low, high)."""
        origin, symbol = np.arange(len(low)), np.zeros(len(low), np.int64)
        for level, zeros in zip(self.levels, self.zeros):
            z_low, z_high, all_zeros = zeros[low], zeros[high], zeros[-1]
            left, right = z_low < z_high, low - z_low < high - z_high
            low = np.concatenate((z_low[left], (all_zeros + low - z_low)[right]))
            high = np.concatenate((z_high[left], (all_zeros + high - z_high)[right]))
            origin = np.concatenate((origin[left], origin[right]))
            symbol = np.concatenate((symbol[left], symbol[right] | (1 << level)))
        return origin, symbol, low + self.shift[symbol], high + self.shift[symbol]

    def words_at(self, low: np.ndarray) -> np.ndarray:
        """The words that follow the delimiters at the given ranks."""
        return np.searchsorted(self.starts, (self.suffixes[low] + 1) % self.size)


def _sorted_rotations(text: np.ndarray, symbols: int) -> np.ndarray:
    """The starts of the text's rotations in order, by doubling what is compared."""
    n, width = len(text), max(1, symbols.bit_length())
    done = max(1, 62 // width)
    rank = np.zeros(n, np.int64)
    for k in range(done):
        rank = (rank << width) | np.roll(text, -k)
    while True:
        order = np.argsort(rank, kind="stable")
        new = np.concatenate(([True], np.diff(rank[order]) != 0))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all() or done >= n:
            return order
        rank = rank * n + np.roll(rank, -done)
        done *= 2


def one_edit(index: Index, patterns: np.ndarray, exact: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, word) of index words that make one of ``patterns`` by one edit left of its last ``exact`` symbols.

    ``patterns`` is a matrix, one pattern a row. Found are words with one symbol
    replaced or one more. A symbol inserted beside equal ones counts at the leftmost place.
    """
    count, length = patterns.shape
    q = np.arange(count)
    low, high = index.extended(np.zeros(count, np.int64), np.full(count, index.size), np.zeros(count, np.int64))

    def onward(state, column):
        q, low, high = state
        low, high = index.extended(low, high, patterns[q, column])
        alive = low < high
        return q[alive], low[alive], high[alive]

    whole = (q, low, high)
    for column in range(length - 1, length - exact - 1, -1):
        whole = onward(whole, column)
    wrong = tuple(np.empty(0, np.int64) for _ in range(3))
    for left in range(length - exact, -1, -1):
        origin, symbol, low, high = index.branches(whole[1], whole[2])
        q = whole[0][origin]
        other = (symbol > 0) & (symbol != (patterns[q, left - 1] if left else 0))
        edited = (q[other], low[other], high[other])
        wrong = tuple(np.concatenate(x) for x in zip(wrong, edited))
        if not left:
            break
        whole = onward(whole, left - 1)
        wrong = tuple(np.concatenate(x) for x in zip(onward(wrong, left - 1), edited))
    q, low, high = wrong
    low, high = index.extended(low, high, np.zeros(len(q), np.int64))
    found = low < high
    return q[found], index.words_at(low[found])


# --- shards -------------------------------------------------------------------------

def _searched(key: tuple, group: pa.Table) -> pa.Table:
    """Per word of a shard: the number of near words found and the most frequent one."""
    forward = key[0].as_py() == "s"
    # numbers in the order of the words' code points
    names, place = np.unique(np.array(group["word"].to_pylist(), dtype=object), return_inverse=True)
    n = np.zeros(len(names), np.int64)
    n[place] = group["n"].to_numpy()
    held, asked = (np.unique(place[group[c].to_numpy()]) for c in ("held", "asked"))
    points = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
    alphabet, codes = np.unique(points, return_inverse=True)
    lengths = np.array([len(w) for w in names])
    parts = np.split(codes.astype(np.int64) + 1, np.cumsum(lengths)[:-1])
    if not forward:
        parts = [p[::-1] for p in parts]
    targets, sources = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(held) and len(asked):
        index = Index([parts[i] for i in held], len(alphabet))
        for length in np.unique(lengths[asked]).tolist():
            half = length // 2
            same = asked[lengths[asked] == length]
            for start in range(0, len(same), CHUNK):
                ids = same[start:start + CHUNK]
                rows, words = one_edit(index, np.stack([parts[i] for i in ids]), length - half if forward else half)
                a, b = ids[rows], held[words]
                longer = lengths[b] > length
                if forward:
                    # with both halves unchanged the other search has it
                    twice = np.array([names[x][:half] == names[y][:half] for x, y in zip(a[longer], b[longer])], bool)
                    keep = np.ones(len(a), bool)
                    keep[np.flatnonzero(longer)[twice]] = False
                    a, b, longer = a[keep], b[keep], longer[keep]
                targets += [a, b[longer]]
                sources += [b, a[longer]]
    target, source = np.concatenate(targets), np.concatenate(sources)
    order = np.lexsort((source, -n[source], target))
    target, source = target[order], source[order]
    first = np.flatnonzero(np.concatenate(([True], np.diff(target) != 0))[:len(target)])
    return pa.table({
        "word": pa.array(names[target[first]], pa.string()), "n_near": np.diff(np.append(first, len(target))).astype(np.int64),
        "best_n": n[source[first]], "best": pa.array(names[source[first]], pa.string()),
    })


def _records(words: DataFrame) -> DataFrame:
    """Each word under its halves: as one that asks, and as one that a word of its length or one less finds."""
    size = F.length("word")

    def under(side: str, length: Column, asked: bool) -> Column:
        half = F.floor(length / 2).cast("int")
        text = F.substring("word", F.lit(1), half) if side == "p" else F.right("word", length - half)
        return F.struct(F.lit(side).alias("side"), length.cast("int").alias("length"), text.alias("half"), F.lit(asked).alias("asked"))

    keys = F.array(*(under(side, size - less, not less) for side in "ps" for less in (0, 1)))
    keys = F.filter(keys, lambda k: k["length"] >= MIN_LENGTH)
    return words.select("word", "n", F.explode(keys).alias("key")).select("word", "n", "key.*")


def near_words(words: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of the words of (word, n) that have words one edit apart."""
    records = _records(words)
    key = ["side", "length", "half"]
    counted = stored(records.groupBy(*key).agg(F.sum(F.length("word")).alias("letters")), "halves")
    total = counted.agg(F.coalesce(F.sum("letters"), F.lit(0)).alias("t")).first()["t"]
    crowded = counted.filter(F.col("letters") > block).select(*key, F.ceil(F.col("letters") / block).cast("int").alias("blocks"))
    # a crowded half has a shard for each block that is asked for and each block that is held
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)

    def tile(held, asked, part: Column, role_held: bool | Column, role_asked: bool | Column) -> Column:
        return F.struct(held.alias("i"), asked.alias("j"), F.lit(role_held).alias("held"), F.lit(role_asked).alias("asked"), part.alias("crowded"))

    once = F.array(tile(F.lit(0), F.lit(0), F.lit(0), True, F.col("asked")))
    held = F.transform(others, lambda o: tile(own, o, F.lit(1), True, False))
    asked = F.transform(others, lambda o: tile(o, own, F.lit(1), False, True))
    tiles = F.when(F.col("blocks").isNull(), once).when(F.col("asked"), F.concat(held, asked)).otherwise(held)
    dealt = records.join(crowded, key, "left").withColumn("tile", F.explode(tiles))
    shards = max(1, -(-total // shard))
    place = F.when(F.col("tile.crowded") == 0, F.pmod(F.xxhash64(*key), F.lit(shards))).otherwise(F.xxhash64(*key, "tile.i", "tile.j"))
    ready = dealt.select("side", "tile.crowded", place.alias("place"), "word", "n", "tile.asked", "tile.held")
    found = ready.groupBy("side", "crowded", "place").applyInArrow(_searched, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top"))
    return merged.select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that following the forms leads to."""
    current = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        current = stored(current.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if current.filter("moved").isEmpty():
            return current.drop("moved")
        current = current.drop("moved")


def spelling_variants(docs: DataFrame, shard: int = SHARD, block: int = BLOCK, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of ``docs`` (doc_id, text)."""
    words = stored(vocabulary(docs, min_count), "vocabulary")
    near = stored(near_words(words, shard, block), "near")
    joined = words.join(near, "word", "left")
    is_form = F.col("best_n") >= RATIO * F.col("n")
    named = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(named.filter("form is not null").select("word", "form"))
    return named.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
