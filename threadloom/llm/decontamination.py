"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. Documents stream through it: at each
word it knows the longest run, ending there, that some item contains. Where that length
reaches ten, the last ten words are a window of an item; an item of fewer words counts where
all of it occurs. Runs of words that no item knows reset the automaton, so only runs of known
words are walked.

Items are cut into pieces that share all but one word of a window and dealt by hash over blocks of
about half of ``block_words`` words; up to ``block_words`` words make one block. Tasks build an
automaton per block, and each is broadcast by itself, packed. Documents are read once: a task holds
the word numbers of a chunk of texts and scans them with one block's automaton after another.

Null texts have no words and are clean; items without words never occur. Equal items are
both reported; null item ids are reported as ''. Repeated rows are judged alike, an empty
table gives an empty one, without items nothing is hit, and columns named like the
results are replaced.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import folded_words, fresh

WINDOW = 10
#: Text that a task holds as word numbers where there are several blocks to scan it with.
CHUNK_CHARS = 64_000_000
PIECE_SCHEMA = "item string, words binary, n_words bigint"
FOUND = "n_words bigint, hits array<struct<start:int,stop:int>>, items array<string>"
#: Words of texts whose upper case still stands.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class SuffixAutomaton:
    """All runs of the items' words, with the items that each window belongs to."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.words.setdefault(w, len(self.words)) for w in words]) for name, words in items if words]
        for _, word_ids in coded:
            last = 0
            for word in word_ids:
                last = self._extend(last, word)
        self.least = min((min(len(w), window) for _, w in coded), default=window)
        self.owners: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        self.top = self._tops()
        self._own(coded)
        self.anchor = self._anchors()

    def packed(self) -> bytes:
        return pickle.dumps(vars(self), pickle.HIGHEST_PROTOCOL)

    @classmethod
    def unpacked(cls, packed: bytes) -> SuffixAutomaton:
        automaton = cls.__new__(cls)
        vars(automaton).update(pickle.loads(packed))
        return automaton

    def _clone(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        self.link[state] = len(self.next) - 1
        return self.link[state]

    def _redirect(self, state: int, word: int, old: int, new: int) -> None:
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]

    def _extend(self, last: int, word: int) -> int:
        """Appends a word to the run of state ``last``; runs of earlier items are shared."""
        there = self.next[last].get(word)
        if there is not None:
            if self.length[there] == self.length[last] + 1:
                return there
            clone = self._clone(there, self.length[last] + 1)
            self._redirect(last, word, there, clone)
            return clone
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        new, state = len(self.next) - 1, last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            there = self.next[state][word]
            if self.length[there] != self.length[state] + 1:
                clone = self._clone(there, self.length[state] + 1)
                self._redirect(state, word, there, clone)
                there = clone
            self.link[new] = there
        return new

    def _by_length(self) -> list[int]:
        return sorted(range(1, len(self.next)), key=self.length.__getitem__)

    def _tops(self) -> list[int]:
        """Per state, the state whose runs are the last ``window`` words of its own; -1 for shorter runs."""
        top = [-1] * len(self.next)
        for state in self._by_length():
            if self.length[state] >= self.window:
                above = self.link[state]
                top[state] = top[above] if self.length[above] >= self.window else state
        return top

    def _own(self, coded: list[tuple[str, list[int]]]) -> None:
        for name, word_ids in coded:
            state = 0
            for i, word in enumerate(word_ids):
                state = self.next[state][word]
                if i + 1 >= self.window:
                    self.owners.setdefault(self.top[state], set()).add(name)
            if len(word_ids) < self.window:
                while self.length[self.link[state]] >= len(word_ids):
                    state = self.link[state]
                self.short.setdefault(state, {}).setdefault(len(word_ids), set()).add(name)

    def _anchors(self) -> list[int]:
        """Per state, the nearest state, itself included, where a short item ends; else -1."""
        anchor = [-1] * len(self.next)
        for state in self._by_length():
            anchor[state] = state if state in self.short else anchor[self.link[state]]
        return anchor

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs of words (start, stop), merged, and the items that occur."""
        return self.scan_ids(np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words)))

    def scan_ids(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """``scan`` for words given by their numbers here, -1 for those that no item has."""
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        hits: list[tuple[int, int]] = []
        full: set[int] = set()
        names: set[str] = set()
        for start, stop in known.reshape(-1, 2):
            if stop - start >= self.least:
                self._walk(ids[start:stop].tolist(), int(start), hits, full, names)
        return merged(hits), names.union(*map(self.owners.__getitem__, full))

    def _walk(self, ids: list[int], at: int, hits: list[tuple[int, int]], full: set[int], names: set[str]) -> None:
        """Adds the hits of a run of known words, the states of its windows and the short items in it."""
        following, link, length, window, top = self.next, self.link, self.length, self.window, self.top
        state = matched = 0
        for place, word in enumerate(ids, at + 1):
            to = following[state].get(word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = following[state].get(word)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= window:
                full.add(top[state])
                if hits and place - window <= hits[-1][1] and hits[-1][0] <= place - window:
                    hits[-1] = (hits[-1][0], place)
                else:
                    hits.append((place - window, place))
            anchor = self.anchor[state]
            while anchor >= 0:
                for size, owners in self.short[anchor].items():
                    if size <= matched:
                        hits.append((place - size, place))
                        names |= owners
                anchor = self.anchor[link[anchor]]


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(hits):
        if out and start <= out[-1][1]:
            if stop > out[-1][1]:
                out[-1] = (out[-1][0], stop)
        else:
            out.append((start, stop))
    return out


def pieces_of(words: list[bytes], most: int, window: int = WINDOW) -> Iterator[list[bytes]]:
    """A long item in pieces of ``most`` words that hold all its windows."""
    if len(words) <= max(most, window):
        yield words
        return
    step = max(most - window + 1, 1)
    for start in range(0, len(words) - window + 1, step):
        yield words[start:start + step + window - 1]


def item_pieces(items: DataFrame, most: int) -> DataFrame:
    """The distinct items, without those that have no words, in pieces of ``most`` words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
                pieces = [words for words in pieces_of(folded_words(text), most) if words]
                yield pa.RecordBatch.from_arrays([
                    pa.array([item] * len(pieces), pa.string()), pa.array([b" ".join(words) for words in pieces], pa.binary()),
                    pa.array([len(words) for words in pieces], pa.int64()),
                ], names=["item", "words", "n_words"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return named.distinct().mapInArrow(cut, PIECE_SCHEMA)


def _built(pieces: pd.DataFrame) -> pd.DataFrame:
    items = [(item, words.split()) for item, words in zip(pieces["item"], pieces["words"], strict=True)]
    return pd.DataFrame({"automaton": [SuffixAutomaton(items).packed()]})


def item_blocks(items: DataFrame, block_words: int) -> list[tuple[str, Broadcast]]:
    """The automata of all blocks, each with a name, built by tasks and broadcast one at a time."""
    pieces = item_pieces(items, max(block_words // 64, 2 * WINDOW))
    total = pieces.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    blocks = 1 if total <= block_words else -(-2 * total // block_words)
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    built = pieces.groupBy(block.alias("block")).applyInPandas(_built, "automaton binary")
    context = items.sparkSession.sparkContext
    return [(uuid.uuid4().hex, context.broadcast(bytes(row["automaton"]))) for row in built.toLocalIterator()]


#: The automaton that this worker used last.
_held: dict[str, SuffixAutomaton] = {}


def _automaton(name: str, shared: Broadcast) -> SuffixAutomaton:
    if name not in _held:
        _held.clear()
        _held[name] = SuffixAutomaton.unpacked(shared.value)
        vars(shared).pop("_value", None)  # or the packed form of every block would stay beside it
    return _held[name]


class Chunk:
    """The texts of some batches as word numbers, and what the blocks have found in them."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.texts: list[np.ndarray] = []
        self.found: list[tuple[list[tuple[int, int]], set[str]]] = []
        self.sizes: list[int] = []
        self.chars = 0

    def add(self, texts: pd.Series) -> None:
        number = self.numbers.__getitem__
        for text in texts:
            words = folded_words(text)
            self.texts.append(np.fromiter(map(number, words), np.int32, len(words)))
            self.found.append(([], set()))
            self.chars += len(text or "")
        self.sizes.append(len(texts))

    def scan(self, automaton: SuffixAutomaton) -> None:
        known = np.fromiter(map(automaton.words.get, self.numbers, repeat(-1)), np.int64, len(self.numbers))
        for i, numbers in enumerate(self.texts):
            hits, names = automaton.scan_ids(known[numbers])
            if hits:
                before, items = self.found[i]
                self.found[i] = (merged(before + hits), items | names)

    def scanned(self, blocks: list[tuple[str, Broadcast]]) -> Iterator[pd.DataFrame]:
        for name, shared in blocks:
            self.scan(_automaton(name, shared))
        yield from self.results()

    def results(self) -> Iterator[pd.DataFrame]:
        at = 0
        for size in self.sizes:
            part = slice(at, at + size)
            yield _result(map(len, self.texts[part]), self.found[part])
            at += size


def _result(n_words: Iterable[int], found: Iterable[tuple[list[tuple[int, int]], set[str]]]) -> pd.DataFrame:
    rows = [
        (n, [{"start": a, "stop": b} for a, b in hits], sorted(names))
        for n, (hits, names) in zip(n_words, found, strict=True)
    ]
    return pd.DataFrame(rows, columns=["n_words", "hits", "items"])


def _scanner(blocks: list[tuple[str, Broadcast]]):
    """A UDF of texts that scans them with all blocks; one block alone needs no numbers of words."""

    @F.pandas_udf(FOUND)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if len(blocks) < 2:
            automaton = _automaton(*blocks[0]) if blocks else SuffixAutomaton([])
            for texts in batches:
                counts, found = [], []
                for words in map(folded_words, texts):
                    counts.append(len(words))
                    found.append(automaton.scan(words))
                yield _result(counts, found)
            return
        chunk = Chunk()
        for texts in batches:
            chunk.add(texts)
            if chunk.chars >= CHUNK_CHARS:
                yield from chunk.scanned(blocks)
                chunk = Chunk()
        yield from chunk.scanned(blocks)

    return scanned


def contamination(docs: DataFrame, items: DataFrame, block_words: int = 200_000) -> DataFrame:
    """``docs`` with n_words, hits (runs of word numbers) and items (the ids that occur)."""
    docs = docs.drop("n_words", "hits", "items")
    found = fresh(docs, "found")
    out = docs.withColumn(found, _scanner(item_blocks(items, block_words))("text"))
    return out.select(*docs.columns, *(F.col(found)[c].alias(c) for c in ("n_words", "hits", "items")))


def report(found: DataFrame) -> list:
    """The counted columns of a scan's result."""
    hit_words = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, h: acc + (h["stop"] - h["start"]))
    return [
        F.col("n_words"), hit_words.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit_words > 0).alias("contaminated"),
    ]


@F.pandas_udf(T.StringType())
def without_runs(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
    """Texts without the given runs of words; what stood between their words goes too."""
    out = []
    for text, firsts, ends in zip(texts, starts, stops, strict=True):
        if firsts is None or not len(firsts):
            out.append(text)
            continue
        kept, at, runs = [], 0, iter(zip(firsts, ends, strict=True))
        first, end = next(runs)
        for number, word in enumerate(WORD.finditer(text)):
            if number == first:
                kept.append(text[at:word.start()])
            if number == end - 1:
                at = word.end()
                first, end = next(runs, (-1, -1))
        out.append("".join(kept) + text[at:])
    return pd.Series(out, dtype=object)


def decontaminated(
    docs: DataFrame, items: DataFrame, most_coverage: float = 0.5
) -> DataFrame:
    """``docs`` without their hit runs: windows of items, and whole items of fewer words.

    A document that the hits cover over ``most_coverage`` goes altogether. ``n_chars``
    follows the text.
    """
    found = contamination(docs, items)
    covered = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, h: acc + (h["stop"] - h["start"]))
    kept = found.filter((covered == 0) | (covered <= most_coverage * F.col("n_words")))
    cut = kept.withColumn("text", F.when(
        F.size("hits") > 0, without_runs("text", F.col("hits")["start"], F.col("hits")["stop"])
    ).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.size("hits") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)
