"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens. The distinct pre-tokens of a batch lie end to end in one
symbol array. In every round each of them finds its lowest-ranked pair and merges all of
that pair's occurrences, leftmost first where they overlap; a pre-token without a ranked
pair is done, and its symbols left are its tokens. A pre-token of more than ``LONG_BYTES``
takes its rounds alone, on linked arrays that wait by rank: a round touches the places of its
pair and their neighbours only, so that its cost follows the merges and not the length. Counts
are kept per worker in a memory of bounded size and summed per text.

The text of a special token counts as one token wherever it stands. A null text counts as
empty: no bytes, no tokens. Texts of any length are read in bounded runs of pre-tokens;
repeated rows count alike, an empty table gives an empty one, other columns stay, and those
named like the results are replaced.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of this tokenizer family, white space spelt out.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
NO_RANK = np.iinfo(np.int64).max
RUN_TOKENS = 200_000
LONG_BYTES = 400
MEMORY_TOKENS = 400_000
BATCH_BYTES = 4_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files, and back to the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merger:
    """Ranks of a byte-level BPE file, and the counting of its tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        kind = content["pre_tokenizer"]
        if content["model"]["type"] != "BPE" or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or content["normalizer"]:
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        vocabulary = content["model"]["vocab"]
        letters = byte_letters()
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocabulary[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in content["model"]["merges"]]
        self.size = max(vocabulary.values()) + 1
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        special = []
        for token in content.get("added_tokens", ()):
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError(f"{path}: added tokens with conditions are not supported")
            special.append(token["content"])
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.memory: dict[str, int] = {}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; ``NO_RANK`` where they never merge."""
        keys = left * self.size + right
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[found] == keys, self.ranks[found], NO_RANK)

    def pair_ranks(self, symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each symbol; none at the last of a pre-token."""
        return np.where(last, NO_RANK, self.ranks_of(symbols, np.append(symbols[1:], 0)))

    def count_long(self, token: bytes) -> int:
        """Tokens of one long pre-token: a round per rank, over the places that wait for it."""
        symbols = self.of_byte[np.frombuffer(token, np.uint8)]
        end = len(symbols)
        before, after = np.arange(-1, end - 1), np.arange(1, end + 1)
        ranks = np.full(end, NO_RANK)
        waiting: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def rank_again(places: np.ndarray) -> None:
            right = after[places]
            ranks[places] = NO_RANK
            places, right = places[right < end], right[right < end]
            ranks[places] = new = self.ranks_of(symbols[places], symbols[right])
            places, new = places[new != NO_RANK], new[new != NO_RANK]
            order = np.argsort(new, kind="stable")
            places, new = places[order], new[order]
            cuts = np.flatnonzero(np.diff(new)) + 1
            for rank, group in zip(new[np.append(0, cuts)].tolist() if len(new) else (), np.split(places, cuts), strict=False):
                if rank not in waiting:
                    heappush(heap, rank)
                waiting[rank].append(group)

        rank_again(np.arange(end))
        count = end
        while heap:
            rank = heappop(heap)
            places = np.unique(np.concatenate(waiting.pop(rank)))
            places = places[ranks[places] == rank]
            if not len(places):
                continue
            # of overlapping occurrences every other one merges
            new_run = np.append(True, after[places[:-1]] != places[1:])
            number = np.arange(len(places))
            places = places[(number - number[new_run][np.cumsum(new_run) - 1]) % 2 == 0]
            gone = after[places]
            beyond = after[gone]
            symbols[places], after[places], ranks[gone] = self.merged[rank], beyond, NO_RANK
            before[beyond[beyond < end]] = places[beyond < end]
            count -= len(places)
            ahead = before[places]
            rank_again(np.unique(np.append(places, ahead[ahead >= 0])))
        return count

    def count_all(self, tokens: list[bytes]) -> np.ndarray:
        """Tokens of each of ``tokens``, none of them empty, the short ones merged side by side."""
        long = [i for i, t in enumerate(tokens) if len(t) > LONG_BYTES]
        if long:
            result = np.zeros(len(tokens), np.int64)
            result[long] = [self.count_long(tokens[i]) for i in long]
            short = np.setdiff1d(np.arange(len(tokens)), long)
            result[short] = self.count_all([tokens[i] for i in short])
            return result
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        result = np.zeros(len(tokens), np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        while len(symbols):
            first = np.append(True, owner[1:] != owner[:-1])
            last = np.append(first[1:], True)
            starts = np.flatnonzero(first)
            ranks = self.pair_ranks(symbols, last)
            lowest = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            done = lowest == NO_RANK
            result[owner[starts[done]]] = sizes[done]
            chosen = (ranks == np.repeat(lowest, sizes)) & (ranks != NO_RANK)
            # of overlapping occurrences, as in a run of one symbol, every other one merges
            places = np.flatnonzero(chosen)
            if not len(places):
                break
            run = np.append(0, np.cumsum(np.diff(places) != 1))
            run_start = places[np.append(True, np.diff(run) > 0)][run]
            places = places[(places - run_start) % 2 == 0]
            symbols = symbols.copy()
            symbols[places] = self.merged[ranks[places]]
            stay = np.repeat(~done, sizes)
            stay[places + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return result

    def _learn(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self.memory]
        if len(self.memory) + len(new) > MEMORY_TOKENS:
            self.memory.clear()
            new = list(tokens)
        if new:
            self.memory.update(zip(new, self.count_all([t.encode("utf-8") for t in new]).tolist(), strict=True))

    def _runs(self, text: str) -> Iterator[list[str]]:
        if len(text) <= RUN_TOKENS:
            yield self.pattern.findall(text)
            return
        matches = (m.group() for m in self.pattern.finditer(text))
        while run := list(islice(matches, RUN_TOKENS)):
            yield run

    def count_texts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text, batch by batch of bounded size."""
        counts = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        weight = 0

        def settle() -> None:
            self._learn(set().union(*(run for _, run in held)))
            for i, run in held:
                counts[i] += sum(map(self.memory.__getitem__, run))
            held.clear()

        for i, text in enumerate(texts):
            segments = [text or ""]
            if self.special and self.special.search(segments[0]):
                segments = self.special.split(segments[0])
                counts[i] += len(segments) - 1
            for segment in segments:
                for run in self._runs(segment):
                    held.append((i, run))
                    weight += 8 * len(run) + sum(map(len, run))
                    if weight > BATCH_BYTES:
                        settle()
                        weight = 0
        settle()
        return counts


@lru_cache(maxsize=1)
def merger(path: str) -> Merger:
    return Merger(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit. ``vocabulary``: a file on every worker."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = merger(vocabulary)
        for texts in batches:
            yield pd.Series(ready.count_texts(texts.tolist()), dtype="int64")

    out = docs.drop("n_bytes", "n_tokens", "over_limit").withColumns({
        "n_bytes": F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")),
        "n_tokens": counted("text"),
    })
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
