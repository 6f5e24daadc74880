"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become a few shape features, computed batch by batch. Boosting goes round the
features in turn: each round adds, per feature, a shallow tree on its binned values, shrunk,
to that feature's lookup table, so that the tables end as one curve per feature. Then the
pairs whose joint bins explain most of what is left get two-way tables by the same rule,
with one split on either side. A score is the logistic of the sum of the tables' entries: bins
by binary search, entries by index, no tree is walked.

The model learns from at most ``sample_rows`` labelled rows, those with the least hashes of
their ids, and is fitted on the driver within that bound. Everything else, features and
scores, covers all rows. Features use the text alone.

Null texts count as empty; empty texts have features of zero and are scored like others.
Labels that are null, or whose document is missing, teach nothing; repeated labels count each. Without labels, or with
one class only, scores are the smoothed share of ones. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import stored

SAMPLE_ROWS = 40_000
BINS, PAIR_BINS = 48, 12
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 6
RATE, PAIR_RATE = 0.12, 0.12
LEAST_LEAF, RIDGE = 20, 5.0

FEATURES = [
    "log_words", "mean_length", "sd_length", "symbols", "capital_words", "exclaims", "dup_lines", "distinct",
    "top_word", "digits", "line_words", "stops", "repeats", "short_words", "single_line_words", "odd_ends",
]
_SYMBOL = re.compile(r"[#*$%&|<>{}\[\]~^=+\\]")
_DIGIT = re.compile(r"[0-9]")
_STOP = re.compile(r"[.!?]")


def features(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], words[2:])))
    short_lines = sum(1 for line in lines if len(line) < 25)
    return [
        float(np.log1p(n)), float(lengths.mean()), float(lengths.std()),
        len(_SYMBOL.findall(text)) / n, sum(map(str.isupper, words)) / n, text.count("!") / n,
        1 - len(set(lines)) / max(1, len(lines)), len(counts) / n**0.85, max(counts.values()) / n,
        len(_DIGIT.findall(text)) / len(text), n / max(1, len(lines)), len(_STOP.findall(text)) / n,
        1 - pairs / max(1, n - 2), float((lengths <= 3).mean()), short_lines / max(1, len(lines)),
        sum(1 for line in lines if line[-1] not in ".!?") / max(1, len(lines)),
    ]


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of every document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "features": [features(t) for t in batch["text"]]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id bigint, features array<double>"
    )


@dataclass
class Model:
    """Edges of bins, the constant, a table per feature and the tables of pairs."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for i, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, i], side="right")]
        for i, j, table in self.pairs:
            a = np.searchsorted(self.coarse[i], x[:, i], side="right")
            total += table[a, np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The step per bin of a tree of up to three leaves over ordered bins."""
    step = np.zeros(len(g))
    leaves = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, 0)
        for a, b in leaves:
            if b - a < 2:
                continue
            gs, hs, ns = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(n[a:b])
            gain = _gain(gs[:-1], hs[:-1]) + _gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1]) - _gain(gs[-1], hs[-1])
            gain[(ns[:-1] < LEAST_LEAF) | (ns[-1] - ns[:-1] < LEAST_LEAF)] = -np.inf
            cut = int(np.argmax(gain))
            if gain[cut] > best[0]:
                best = (float(gain[cut]), (a, b), a + cut + 1)
        if best[1] is None:
            break
        a, b = best[1]
        leaves[leaves.index((a, b)):leaves.index((a, b)) + 1] = [(a, best[2]), (best[2], b)]
    for a, b in leaves:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best single split on either side of a grid: its gain and the step per cell."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for s in (gs, hs):
        corner, top, left, whole = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1], s[-1, -1]
        parts.append((corner, top - corner, left - corner, whole - top - left + corner))
    gain = sum(_gain(a, b) for a, b in zip(*parts, strict=True)) - _gain(gs[-1, -1], hs[-1, -1])
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    step = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            step[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the tables on a bounded sample."""
    ones = float(y.sum())
    base = float(np.log((ones + 1) / (len(y) - ones + 1)))
    if not len(y) or ones in (0.0, float(len(y))):
        return Model(base)
    model = Model(base)
    count = x.shape[1]
    model.edges = [_edges(x[:, i], BINS) for i in range(count)]
    model.coarse = [_edges(x[:, i], PAIR_BINS) for i in range(count)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    fine = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(model.coarse)]
    logit = np.full(len(y), base)
    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(fine, model.tables, strict=True)]
    for _ in range(ROUNDS):
        for i in range(count):
            p = 1 / (1 + np.exp(-logit))
            size = len(model.tables[i])
            g, h = np.bincount(fine[i], y - p, size), np.bincount(fine[i], p * (1 - p), size)
            step = RATE * _shallow_tree(g, h, rows[i])
            model.tables[i] += step
            logit += step[fine[i]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        cell = coarse[i] * shape[1] + coarse[j]
        size = shape[0] * shape[1]
        return np.bincount(cell, y - p, size).reshape(shape), np.bincount(cell, p * (1 - p), size).reshape(shape)

    ranked = sorted(
        ((_quadrants(*grid(i, j))[0], -i, -j) for i in range(count) for j in range(i + 1, count)), reverse=True
    )
    chosen = [(-i, -j) for gain, i, j in ranked[:PAIRS] if gain > 0]
    tables = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(chosen, tables, strict=True):
            step = PAIR_RATE * _quadrants(*grid(i, j))[1]
            table += step
            logit += step[coarse[i], coarse[j]]
    model.pairs = [(i, j, t) for (i, j), t in zip(chosen, tables, strict=True)]
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learned(featured_docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled rows that are not held out, at most ``sample_rows`` of them."""
    known = labels.select(F.col("doc_id").cast("long").alias("_doc"), F.col("quality").cast("int").alias("y"))
    known = known.filter("y is not null and _doc is not null").filter(~held_out(F.col("_doc")))
    joined = featured_docs.join(known, F.col("doc_id") == F.col("_doc"))
    sample = joined.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "features").limit(sample_rows).select("features", "y").collect()
    x = np.array([r["features"] for r in sample], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([float(r["y"] > 0) for r in sample]))


def scored(featured_docs: DataFrame, model: Model, cut: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted); the model's tables are of fixed size."""
    shared = featured_docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        x = np.stack(rows.to_numpy()) if len(rows) else np.empty((0, len(FEATURES)))
        return pd.Series(shared.value.score(x))

    out = featured_docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("features").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def classified(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    ready = stored(featured(docs), "features")
    return scored(ready, learned(ready, labels, sample_rows))
