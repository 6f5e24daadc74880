"""Certified cell search: the exact top-k, reading only cells that can hold a part of it.

Each cell keeps the widest angle between its centre and its rows. By the triangle inequality
no row of a cell is nearer to a query than the angle to the centre less that
width. The nearest cells are searched first; their k-th hit rules out every cell whose bound
lies below it, and the cells left are searched in a second pass, which passes on only
what reaches that k-th hit.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.vectors import (
    MAX_BROADCAST_QUERIES, TILE_ROWS, Hits, _candidates, _matrix, _ranked, _unit_rows,
)
from threadloom.runtime import stored

# Covers what the angles and similarities lose in rounding.
_SLACK = 1e-7


class CellBounds(NamedTuple):
    """Centres of cells, one row each, with what their rows allow for."""

    centres: np.ndarray
    widths: np.ndarray  # widest angle to a row; negative for a cell without rows
    zeros: np.ndarray  # does the cell hold a zero vector? It is similar to nothing by 0

    def clusterCenters(self) -> np.ndarray:
        return self.centres

    def ceilings(self, points: np.ndarray) -> np.ndarray:
        """The largest similarity a row of each cell may have with each unit point."""
        apart = np.arccos(np.clip(points @ _unit_rows(self.centres).T, -1, 1))
        highest = np.cos(np.maximum(apart - self.widths - _SLACK, 0))
        highest[~points.any(axis=1)] = 0
        highest = np.where(self.zeros, np.maximum(highest, 0), highest)
        return np.where(self.widths < 0, -np.inf, highest)


def cell_bounds(celled: DataFrame, model) -> CellBounds:
    """One scan of a collection with ``cell``; to be repeated when rows are added to it."""
    centres = np.array(model.clusterCenters(), dtype=np.float64)
    units = _unit_rows(centres)

    def widest(batches):
        width, zero = np.full(len(units), -1.0), np.zeros(len(units), bool)
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("embedding")))
            if batch.num_rows:
                cells = batch.column("cell").to_numpy()
                rows = _matrix(batch.column("embedding"))
                apart = np.arccos(np.clip((rows * units[cells]).sum(axis=1), -1, 1))
                # a centre without direction says nothing about its rows
                apart = np.where(units[cells].any(axis=1), apart, np.pi)
                empty = ~rows.any(axis=1)
                np.maximum.at(width, cells, np.where(empty, 0, apart))
                zero[cells[empty]] = True
        held = np.flatnonzero(width >= 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(width[held]), pa.array(zero[held])],
            names=["cell", "width", "zero"],
        )

    known = celled.select(F.col("cell").cast("int").alias("cell"), "embedding")
    found = known.mapInArrow(widest, "cell int, width double, zero boolean")
    widths, zeros = np.full(len(centres), -1.0), np.zeros(len(centres), bool)
    # one row per cell
    for row in found.groupBy("cell").agg(F.max("width").alias("width"), F.max("zero").alias("zero")).collect():
        widths[row["cell"]], zeros[row["cell"]] = row["width"], row["zero"]
    return CellBounds(centres, widths, zeros)


def write_bounds(spark: SparkSession, bounds: CellBounds, path: str) -> None:
    rows = [
        (i, c.tolist(), float(w), bool(z)) for i, (c, w, z) in enumerate(zip(*bounds))
    ]
    schema = "cell int, centre array<double>, width double, zero boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def read_bounds(spark: SparkSession, path: str) -> CellBounds:
    rows = sorted(spark.read.parquet(path).collect())
    return CellBounds(
        np.array([r["centre"] for r in rows]), np.array([r["width"] for r in rows]),
        np.array([r["zero"] for r in rows]),
    )


def _places(bounds: CellBounds, probes: int, vector: Column, types: Column, reached: Column | None = None) -> Column:
    """(groups, floors) of each query: for each of its types the cells to be searched.

    Without ``reached`` the cells with the ``probes`` highest bounds; with it, a map from types to k-th
    similarities, all others that may hold a hit.
    """
    @F.pandas_udf("groups array<string>, floors array<double>")
    def places(vectors: pd.Series, types: pd.Series, reached: pd.Series) -> pd.DataFrame:
        highest = bounds.ceilings(_unit_rows(np.array(vectors.tolist(), dtype=np.float64)))
        order = np.argsort(-highest, axis=1, kind="stable")
        groups, floors = [], []
        for row, names, known in zip(range(len(order)), types, reached):
            own: tuple[list, list] = ([], [])
            known = dict(known) if known is not None else None
            for name in names if names is not None else []:
                floor = -np.inf if known is None else known.get(name, -np.inf)
                cells = order[row, :probes] if known is None else order[row, probes:]
                cells = cells[(highest[row, cells] > -np.inf) & (highest[row, cells] >= floor - _SLACK)]
                own[0].extend(f"{name}/{c}" for c in cells)
                own[1].extend([floor] * len(cells))
            groups.append(own[0])
            floors.append(own[1])
        return pd.DataFrame({"groups": groups, "floors": floors})

    nothing = F.lit(None).cast("map<string,double>")
    return places(vector, types, nothing if reached is None else reached)


def _certified(searched: DataFrame, queries: DataFrame, bounds: CellBounds, limits: dict[str, int],
               probes: int, max_queries: int, tile_rows: int) -> Hits:
    """(query_id, type, id, similarity, rank) of (id, grp, embedding) for (query_id, types, embedding)."""
    most = {"*": max(limits.values())}
    queries = queries.where(F.col("embedding").isNotNull())
    allowed = F.create_map(*[F.lit(v) for pair in limits.items() for v in pair])[F.col("type")]

    def found(asked: DataFrame) -> Hits:
        hits, few, groups = _candidates(searched, asked, most, max_queries, tile_rows)
        return Hits(hits.withColumn("type", F.substring_index("grp", "/", 1)).drop("grp"), few, groups)

    def ranked(hits: DataFrame) -> DataFrame:
        return _ranked(hits, ["query_id", "type"], allowed)

    near = queries.select("*", _places(bounds, probes, F.col("embedding"), F.col("types")).alias("at"))
    near = near.select("query_id", "embedding", F.col("at.groups").alias("groups"))
    first = found(near)
    # stored: the second pass starts from these hits and is merged with them
    hits = stored(ranked(first.rows).select("query_id", "type", "id", "similarity", "rank"), "near")
    kth = hits.where(F.col("rank") == allowed).groupBy("query_id").agg(
        F.map_from_entries(F.collect_list(F.struct("type", "similarity"))).alias("reached"))
    known = queries.join(kth, "query_id", "left").withColumn(
        "reached", F.coalesce("reached", F.create_map().cast("map<string,double>")))
    far = known.select("query_id", "embedding", _places(
        bounds, probes, F.col("embedding"), F.col("types"), F.col("reached")).alias("at"))
    far = far.select("query_id", "embedding", "at.groups", "at.floors").where(F.size("groups") > 0)
    second = found(stored(far, "far"))
    groups = None
    if first.groups is not None and second.groups is not None:
        groups = tuple(sorted({*first.groups, *second.groups}))
    merged = ranked(hits.drop("rank").unionByName(second.rows))
    return Hits(merged.select("query_id", "type", "id", "similarity", "rank"), first.few and second.few, groups)


def search_cells_exact(celled: DataFrame, queries: DataFrame, bounds: CellBounds, k: int, probes: int = 4,
                       max_queries: int = MAX_BROADCAST_QUERIES, tile_rows: int = TILE_ROWS) -> Hits:
    """``search`` on a collection with ``cell``: the same rows, fewer cells read.

    ``groups`` of the result names the cells read, where the queries are few.
    """
    found = _certified(
        celled.select("id", F.concat(F.lit("/"), F.col("cell").cast("string")).alias("grp"), "embedding"),
        queries.select("query_id", F.array(F.lit("")).alias("types"), "embedding"),
        bounds, {"": k}, probes, max_queries, tile_rows,
    )
    return found._replace(rows=found.rows.drop("type"))


def search_cells_by_type_exact(celled: DataFrame, queries: DataFrame, bounds: CellBounds, limits: dict[str, int],
                               probes: int = 4, max_queries: int = MAX_BROADCAST_QUERIES,
                               tile_rows: int = TILE_ROWS) -> Hits:
    """``search_by_type`` on a collection with ``type`` and ``cell``: the same rows, fewer cells read."""
    known = F.filter("types", lambda t: t.isin(list(limits)))
    return _certified(
        celled.where(F.col("type").isin(list(limits))).select(
            "id", F.concat("type", F.lit("/"), F.col("cell").cast("string")).alias("grp"), "embedding"),
        queries.select("query_id", known.alias("types"), "embedding"),
        bounds, limits, probes, max_queries, tile_rows,
    )
