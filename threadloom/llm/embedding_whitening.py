"""Embedding whitening by a weighted multiplicity covariance.

Entries become integers, identical integer vectors become one row with their number, and the
covariance is fitted on these rows, each weighing one or as often as it occurs. Sums per
dimension are exact integers. A task subtracts the mean from its rows, multiplies them as a
matrix, weighted, and hands on one matrix; only the sum of these, as large as the model, reaches
the driver. Each distinct vector is whitened once and joined back to its rows.

Rows whose vector is null, or holds a null, a NaN, an infinite entry or one beyond
``LARGEST``, are dropped; so is an empty vector. Vectors of different lengths are whitened
among those of their own length. Repeated rows stay, and weigh as ``weights`` says. Components
without spread (all vectors equal, or fewer vectors than dimensions) are left out, so equal
vectors only, or an empty table, give no rows. Among equal eigenvalues the order is arbitrary.
Columns of the input stay, but for those that have a result's name.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import fresh, joined_by_weight, stored

SCALE, OFFSET = 64, 1_000_000
#: Entries beyond are dropped with their row: their integers would leave the exact range.
LARGEST = float(1 << 40)
#: Numbers of all covariances together; they are summed up on the driver.
MAX_COVARIANCE = 1 << 26
RESULTS = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


class Whitener(NamedTuple):
    """What is fitted for the vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray
    trace: float
    directions: np.ndarray


def integers(vector: Column) -> Column:
    """The entries as integers; null for a vector that is to be dropped."""
    sound = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= LARGEST))
    whole = F.transform(vector, lambda c: F.floor(SCALE * c.cast("double")) + OFFSET)
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & sound, whole)


def distinct_vectors(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("x")).agg(F.count("*").alias("many"))


def _matrices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """Per batch and length of vector: the vectors as a matrix, and their rows."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == size))
            yield size, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, size), part


def _weights(part: pa.RecordBatch, weights: str) -> np.ndarray:
    if weights == "one":
        return np.ones(part.num_rows, np.int64)
    return part.column("many").to_numpy()


def exact_sums(distinct: DataFrame, weights: str) -> dict[int, tuple[int, list[int]]]:
    """Per length of vector: the sum of weights and the exact weighted sum of each dimension."""
    schema = "size int, place int, n long, high long, low long"

    def partial(batches):
        found: dict = {}
        for size, x, part in _matrices(batches, "x"):
            w = _weights(part, weights)[:, None]
            # two halves, so that no sum of a task leaves 64 bits
            sums = np.stack([((x >> 26) * w).sum(axis=0), ((x & ((1 << 26) - 1)) * w).sum(axis=0)])
            n, before = found.get(size, (0, 0))
            found[size] = n + int(w.sum()), before + sums
        for size, (n, (high, low)) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, size, np.int32)), pa.array(np.arange(size, dtype=np.int32)),
                 pa.array(np.full(size, n)), pa.array(high), pa.array(low)],
                names=["size", "place", "n", "high", "low"],
            )

    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    out: dict = {}
    for row in distinct.mapInArrow(partial, schema).groupBy("size", "place").agg(*whole).orderBy("size", "place").collect():
        _, sums = out.setdefault(row["size"], (int(row["n"]), []))
        sums.append((int(row["high"]) << 26) + int(row["low"]))
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, in 64 bits where that holds it and in Python's integers elsewhere."""
    if n * int(np.abs(x).max(initial=1)) + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return deviations(x, n, sums).astype(np.float64) / n


def squares(apart: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if apart.dtype == object or int(np.abs(apart).max(initial=0)) ** 2 * apart.shape[1] >= 1 << 63:
        apart = apart.astype(object)
    return [int(v) for v in (apart * apart).sum(axis=1)]


def _products(df: DataFrame, column: str, weights: str, prepare) -> dict[int, np.ndarray]:
    """Per length: the weighted sum of the products of all pairs of dimensions.

    ``prepare`` makes rows of doubles of a length and its matrix. Each task hands on one matrix.
    """
    def partial(batches):
        found: dict = {}
        for size, x, part in _matrices(batches, column):
            rows = prepare(size, x)
            found[size] = found.get(size, 0) + (rows * _weights(part, weights)[:, None]).T @ rows
        for size, matrix in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(matrix), size, np.int32)), pa.array(np.arange(len(matrix), dtype=np.int32)),
                 pa.array(list(matrix), pa.list_(pa.float64()))],
                names=["size", "place", "line"],
            )

    lines = df.mapInArrow(partial, "size int, place int, line array<double>")
    cells = lines.select("size", "place", F.posexplode("line").alias("other", "v"))
    out: dict = {}
    for row in cells.groupBy("size", "place", "other").agg(F.sum("v").alias("v")).collect():
        out.setdefault(row["size"], {})[row["place"], row["other"]] = row["v"]
    dense = {}
    for size, values in out.items():
        width = 1 + max(i for i, _ in values)
        dense[size] = np.array([[values[i, j] for j in range(width)] for i in range(width)])
    return dense


def fit(distinct: DataFrame, components: int = 16, weights: str = "one") -> dict[int, Whitener]:
    """A whitener per length of vector, of a table (x, many) of distinct vectors."""
    if weights not in ("one", "count"):
        raise ValueError(f"weights are 'one' or 'count', not {weights!r}")
    totals = exact_sums(distinct, weights)
    if sum(size * size for size in totals) > MAX_COVARIANCE:
        raise ValueError(f"covariances of {sorted(totals)} dimensions are too large to be solved")
    scatter = _products(distinct, "x", weights, lambda size, x: centred(x, *totals[size]))
    fitted = {}
    for size, (n, sums) in totals.items():
        covariance = scatter[size] / n
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        spread = values > size * np.finfo(np.float64).eps * 16 * max(values[0], 0)
        count = min(components, int(spread.sum()))
        fitted[size] = Whitener(n, sums, values[:count], float(np.trace(covariance)), vectors[:, :count])
    return fitted


def whitened_vectors(distinct: DataFrame, fitted: dict[int, Whitener]) -> DataFrame:
    """(x, many, deviation, whitened): each distinct vector once. A deviation beyond 38 digits is null."""
    schema = "x array<bigint>, many long, deviation decimal(38,0), whitened array<double>"

    def project(batches):
        for size, x, part in _matrices(batches, "x"):
            model = fitted[size]
            apart = deviations(x, model.n, model.sums)
            rows = (apart.astype(np.float64) / model.n) @ (model.directions / np.sqrt(model.values))
            sums = [Decimal(v) if v < 10**38 else None for v in squares(apart)]
            yield pa.RecordBatch.from_arrays(
                [part.column("x"), part.column("many"), pa.array(sums, pa.decimal128(38, 0)),
                 pa.array(list(rows), pa.list_(pa.float64()))],
                names=["x", "many", "deviation", "whitened"],
            )

    return distinct.select("x", "many").mapInArrow(project, schema)


def identity_errors(done: DataFrame, fitted: dict[int, Whitener], weights: str) -> dict[int, float]:
    """Per length: how far the covariance of the whitened vectors is from the identity at most."""
    errors = {}
    for size, model in fitted.items():
        if not len(model.values):
            continue
        own = done.filter(F.size("x") == size)
        # a constant last column carries the sums along
        products = _products(own, "whitened", weights, lambda _, y: np.column_stack([y, np.ones(len(y))]))
        gram = products[len(model.values)] / model.n
        mean = gram[-1, :-1]
        errors[size] = float(np.abs(gram[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max())
    return errors


def whitened(rows: DataFrame, vector: str = "embedding", components: int = 16, weights: str = "one") -> DataFrame:
    """One row per remaining row of ``rows`` and component: its columns and ``RESULTS``."""
    kept = [c for c in rows.columns if c.lower() not in RESULTS]
    key = fresh(rows, "x")
    keyed = rows.select(*kept, integers(F.col(vector)).alias(key)).filter(F.col(key).isNotNull())
    distinct = stored(distinct_vectors(keyed, key), "vectors")
    fitted = fit(distinct, components, weights)
    done = stored(whitened_vectors(distinct, fitted), "whitened")
    errors = identity_errors(done, fitted, weights)

    def by_size(value, kind: str) -> Column:
        known = F.lit(None).cast(kind)
        for size, model in fitted.items():
            known = F.when(F.size(F.col(key)) == size, F.lit(value(size, model)).cast(kind)).otherwise(known)
        return known

    # the results' names are free now; the key of the join has a name that the input lacks
    lookup = done.select(F.col("x").alias(key), "many", "deviation", "whitened")
    joined = joined_by_weight(keyed, lookup.withColumnRenamed("many", _weight := fresh(keyed, "many")), key, _weight)
    unfolded = joined.select(*kept, key, "deviation", F.posexplode("whitened").alias("component", "whitened"))
    shares = by_size(lambda _, m: [float(v) / m.trace for v in m.values], "array<double>")
    return unfolded.select(
        *kept, (F.col("component") + 1).alias("component"), by_size(lambda _, m: m.n, "long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("component")).alias("explained"),
        by_size(lambda s, _: errors.get(s), "double").alias("identity_error"),
    )
