"""Embedding, exact top-k, cell-probing approximate top-k and collection upkeep."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import fixed
from threadloom.functions.metadata import metadata
from threadloom.functions.text import is_blank, line, py_strip
from threadloom.operators.messages import from_person
from threadloom.operators.ordered import global_index
from threadloom.runtime import estimated_bytes

# At most this many query vectors, of this many numbers in all, travel to every task;
# larger sets go tile by tile.
MAX_BROADCAST_QUERIES = 8192
MAX_BROADCAST_VALUES = 1 << 25
# Larger query sets are cut into blocks, collections into slices, neither finer than this many
# rows (this many times the broadcast limit of queries) or a chunk.
TILE_ROWS = 200_000
_TILE_BLOCKS = 4
# A task holds a block, of at most this many queries and numbers, and reads its slice in chunks.
# A tile, one block against one slice, has a share of all pairs between these bounds.
BLOCK_QUERIES, BLOCK_VALUES = 32_768, 1 << 23
TILES, LEAST_PAIRS, MOST_PAIRS = 256, 1 << 27, 1 << 32
# Collections estimated to be larger are searched in one task of so many first.
SAMPLE_BYTES = 4 << 30
SAMPLE_STEP = 32
# Similarities computed at a time: a strip of queries by a chunk of rows.
_QUERY_STRIP = 512
_ROW_CHUNK = 2048
_FIRST_CHUNK = 256
# Where fewer than one pair in so many may matter, these are computed one by one.
_FEW = 32
_DECIMALS = 9
_ANY = "*"


# --- embedding ------------------------------------------------------------------

def embed_with(load: Callable[[], Callable[[list[str]], np.ndarray]], text: Column,
               batch_size: int = 100) -> Column:
    """``text`` through a user's model; ``load`` runs once per Python worker task."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            values = [t or "" for t in texts]
            parts = [
                np.asarray(encode(values[i:i + batch_size]), dtype=np.float32)
                for i in range(0, len(values), batch_size)
            ]
            yield pd.Series(list(np.concatenate(parts)) if parts else [], dtype=object)

    return embed(text)


def hashed_term_counts(df: DataFrame, text: str, name: str, dimensions: int = 256) -> DataFrame:
    """Adds sparse vector ``name``: hashed counts of the lower-cased words."""
    words = Tokenizer(inputCol="_text", outputCol="_words")
    counts = HashingTF(inputCol="_words", outputCol=name, numFeatures=dimensions)
    filled = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    return counts.transform(words.transform(filled)).drop("_text", "_words")


def fit_word_weights(documents: DataFrame, text: str, dimensions: int = 256):
    """Inverse document frequencies of the hashed words, for ``embed_hashed``."""
    counted = hashed_term_counts(documents, text, "_counts", dimensions)
    return IDF(inputCol="_counts", outputCol="_weighted").fit(counted.select("_counts"))


def embed_hashed(df: DataFrame, text: str, name: str = "embedding", dimensions: int = 256,
                 weights=None) -> DataFrame:
    """Adds a model-free embedding of length one; the same call serves documents and queries."""
    made = hashed_term_counts(df, text, "_counts", dimensions)
    if weights is not None:
        made = weights.transform(made)
    source = "_counts" if weights is None else "_weighted"
    scaled = Normalizer(inputCol=source, outputCol="_unit").transform(made)
    return scaled.withColumn(name, vector_to_array("_unit", "float32")).drop(
        "_counts", "_weighted", "_unit"
    )


# --- top-k inside a task ----------------------------------------------------------

def _unit_rows(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as unit rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit_rows(flat.reshape(len(column), -1))


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k largest entries per row; among equals the leftmost win."""
    if sims.shape[1] <= k:
        return np.ones(sims.shape, dtype=bool)
    cut = -np.partition(-sims, k - 1, axis=1)[:, k - 1:k]
    above = sims > cut
    level = sims == cut
    room = k - above.sum(axis=1, keepdims=True)
    return above | (level & (np.cumsum(level, axis=1) <= room))


class _Leaders:
    """The k nearest ids so far for each query of one group, none below its floor."""

    def __init__(self, queries: np.ndarray, k: int, floors: np.ndarray, numeric: bool = False):
        self.queries, self.k, self.floors = queries, k, floors
        self.sims = np.full((len(queries), k), -np.inf)
        self.ids = np.zeros((len(queries), k), np.int64) if numeric else np.full((len(queries), k), None, dtype=object)
        # Products in single precision say which rows and queries may matter; unit vectors bound their error.
        self.thin = queries.astype(np.float32)
        self.slack = (queries.shape[1] + 8) * 2.0**-23

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """``ids`` ascending, so that leftmost means smallest among equal similarities."""
        # a small first chunk, so that a bar is known for the others
        starts = [0, *range(_FIRST_CHUNK if np.isneginf(self.sims[:, -1]).any() else _ROW_CHUNK, len(ids), _ROW_CHUNK)]
        for low, high in zip(starts, [*starts[1:], len(ids)]):
            chunk = slice(low, high)
            names, rows, thin = ids[chunk], vectors[chunk], vectors[chunk].astype(np.float32)
            for start in range(0, len(self.queries), _QUERY_STRIP):
                strip = np.arange(start, min(start + _QUERY_STRIP, len(self.queries)))
                bar = np.maximum(self.sims[strip, -1], self.floors[strip])[:, None]
                close = self.thin[strip] @ thin.T >= (bar - self.slack).astype(np.float32)
                n_close = np.count_nonzero(close)
                if n_close > close.size // _FEW:
                    near, useful = close.any(axis=1), close.any(axis=0)
                    self._take(strip[near], names[useful], rows[useful])
                elif n_close:
                    of, place = np.divmod(np.flatnonzero(close), close.shape[1])
                    self._take_few(strip[of], names[place], rows[place])

    def _take_few(self, of: np.ndarray, names: np.ndarray, vectors: np.ndarray) -> None:
        """Single pairs of a query and a row, sorted by query and then by id."""
        sims = np.round(np.einsum("ij,ij->i", self.queries[of], vectors), _DECIMALS)
        reached = sims >= np.maximum(self.sims[of, -1], self.floors[of])
        of, names, sims = of[reached], names[reached], sims[reached]
        order = np.lexsort((-sims, of))  # stable: the smaller id first among equals
        of, names, sims = of[order], names[order], sims[order]
        strip, first, many = np.unique(of, return_index=True, return_counts=True)
        place = np.arange(len(of)) - np.repeat(first, many)
        best = place < self.k
        rows = np.repeat(np.arange(len(strip)), many)[best]
        width = min(int(many.max(initial=0)), self.k)
        if width:
            new_sims = np.full((len(strip), width), -np.inf)
            new_ids = np.zeros((len(strip), width), self.ids.dtype)
            new_sims[rows, place[best]], new_ids[rows, place[best]] = sims[best], names[best]
            self._merge(strip, new_sims, new_ids)

    def _take(self, strip: np.ndarray, names: np.ndarray, vectors: np.ndarray) -> None:
        # Rounded, so that copies of a vector tie wherever they are stored.
        sims = np.round(self.queries[strip] @ vectors.T, _DECIMALS)
        rows, cols = np.nonzero(_best(sims, self.k))
        found = len(rows) // len(sims)
        new_sims = sims[rows, cols].reshape(len(sims), found)
        new_ids = names[cols].reshape(len(sims), found)
        self._merge(strip, new_sims, new_ids)

    def _merge(self, strip: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> None:
        all_sims = np.concatenate([self.sims[strip], sims], axis=1)
        all_ids = np.concatenate([self.ids[strip], ids], axis=1)
        names = all_ids
        if all_ids.dtype == object:
            filled = np.isfinite(all_sims)
            names = np.full(all_sims.shape, -1)
            names[filled] = np.unique(all_ids[filled], return_inverse=True)[1]
        order = np.lexsort((names, -all_sims), axis=1)[:, : self.k]
        self.sims[strip] = np.take_along_axis(all_sims, order, axis=1)
        self.ids[strip] = np.take_along_axis(all_ids, order, axis=1)

    def found(self, group: str, query_ids: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        rows, cols = np.nonzero(np.isfinite(self.sims) & (self.sims >= self.floors[:, None]))
        if len(rows):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(query_ids[rows].tolist(), schema.field(0).type),
                    pa.array([group] * len(rows), schema.field(1).type),
                    pa.array(self.ids[rows, cols].tolist(), schema.field(2).type),
                    pa.array(self.sims[rows, cols], pa.float64()),
                ],
                schema=schema,
            )


def _names(column: pa.ChunkedArray, numeric: bool) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.int64 if numeric else object)


def _scan(batches, query_ids, query_vectors, wanted, limits, schema, floors):
    """Arrow batches of (id, group, embedding) to the local leaders per query and group.

    ``floors`` holds, for a group, a similarity per query that hits are known to reach.
    """
    leaders: dict = {}
    numeric = pa.types.is_integer(schema.field("id").type)
    names = np.array(query_ids, dtype=object)
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table.filter(pc.is_valid(table["embedding"])).combine_chunks()
        if table.num_rows == 0:
            continue
        vectors = _matrix(table["embedding"].combine_chunks())
        ids = _names(table["id"], numeric)
        groups = np.array(table["grp"].to_pylist(), dtype=object)
        by_id = np.argsort(ids, kind="stable")
        for group in set(groups):
            if group not in wanted:
                continue
            if group not in leaders:
                leaders[group] = _Leaders(
                    query_vectors[wanted[group]], limits.get(group, limits.get(_ANY)),
                    floors.get(group, np.full(len(wanted[group]), -np.inf)), numeric,
                )
            rows = by_id[groups[by_id] == group]
            leaders[group].offer(ids[rows], vectors[rows])
    for group, found in leaders.items():
        yield from found.found(group, names[wanted[group]], schema)


def _scan_tiles(batches, limits, schema):
    """Arrow batches sorted by tile, the queries of each before its rows, to the leaders of each tile.

    The queries of one tile are held, rows only batch by batch.
    """
    numeric = pa.types.is_integer(schema.field("id").type)
    tile, group, block, names, leaders = None, None, [], None, None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        marks = table["_tile"].to_numpy() * 2 + table["_row"].to_numpy().astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            part = table.slice(a, b - a)
            if marks[a] // 2 != tile:
                if leaders is not None:
                    yield from leaders.found(group, names, schema)
                tile, group, block, leaders = marks[a] // 2, part["grp"][0].as_py(), [], None
            if marks[a] % 2 == 0:
                block.append(part.select(["query_id", "embedding", "floor"]))
                continue
            if leaders is None:
                if not block:
                    continue  # no query has come to this block
                held, block = pa.concat_tables(block), []
                names = np.array(held["query_id"].to_pylist(), dtype=object)
                leaders = _Leaders(_matrix(held["embedding"].combine_chunks()), limits.get(group, limits.get(_ANY)),
                                   held["floor"].to_numpy(), numeric)
            ids = _names(part["id"], numeric)
            by_id = np.argsort(ids, kind="stable")
            leaders.offer(ids[by_id], _matrix(part["embedding"].combine_chunks())[by_id])
    if leaders is not None:
        yield from leaders.found(group, names, schema)


def _grid(sizes: list, max_queries: int, tile_rows: int, dimensions: int) -> list[tuple]:
    """(group, blocks, slices, first tile) for each (group, queries, rows).

    Blocks are bounded by what a task may hold; beyond that tiles have about the same number of
    pairs, and the sides are cut so that few copies of queries and rows move.
    """
    most = max(min(BLOCK_QUERIES, BLOCK_VALUES // dimensions), 1)
    pairs = sum(q * n for _, q, n in sizes) / TILES
    pairs = min(max(pairs, LEAST_PAIRS), MOST_PAIRS)
    out, first = [], 0
    for group, asked, rows in sizes:
        tiles = max(asked * rows / pairs, 1)
        finest = -(-asked // min(_TILE_BLOCKS * max_queries, _ROW_CHUNK)), -(-rows // min(tile_rows, _ROW_CHUNK))
        blocks = max(min(round((tiles * asked / rows) ** 0.5), finest[0]), -(-asked // most), 1)
        slices = max(min(round(tiles / blocks), finest[1]), 1)
        out.append((group, blocks, slices, first))
        first += blocks * slices
    return out


def _wanted(groups: list, floors: list | None = None) -> tuple[dict, dict]:
    """Group to the positions of the queries that search it, and to their floors."""
    wanted: dict = {}
    known: dict = {}
    for position, names in enumerate(groups):
        for place, name in enumerate(names or []):
            wanted.setdefault(name, []).append(position)
            if floors is not None:
                known.setdefault(name, []).append(floors[position][place])
    return {name: np.array(rows) for name, rows in wanted.items()}, {
        name: np.array(values, np.float64) for name, values in known.items()}


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    kind = df.schema[column].dataType.simpleString()
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]


class Hits(NamedTuple):
    """Found rows, and whether the query side passed the size check for broadcasting."""

    rows: DataFrame
    few: bool
    groups: tuple[str, ...] | None = None


def _sampled_floors(collection: DataFrame, block, limits: dict, schema, out: str) -> dict:
    """Per group and query: the last of the top-k among the rows of some tasks.

    No hit lies below. One task in ``SAMPLE_STEP`` scans, the others read nothing.
    """
    def scan(batches):
        if TaskContext.get().partitionId() % SAMPLE_STEP == 0:
            names, vectors, wanted, floors = block.value
            yield from _scan(batches, names, vectors, wanted, limits, schema, floors)

    names, _, wanted, _ = block.value
    limit = F.lit(limits.get(_ANY))
    for group in limits:
        if group != _ANY:
            limit = F.when(F.col("grp") == group, limits[group]).otherwise(limit)
    best = _ranked(collection.mapInArrow(scan, out), ["query_id", "grp"], limit)
    # one row per query and group: of the size of the broadcast queries
    full = best.where(F.col("rank") == limit).select("query_id", "grp", "similarity").collect()
    found = {(r["grp"], r["query_id"]): r["similarity"] for r in full}
    return {g: np.array([found.get((g, names[i]), -np.inf) for i in rows]) for g, rows in wanted.items()}


def _candidates(collection: DataFrame, queries: DataFrame, limits: dict, max_queries: int,
                tile_rows: int, sample_bytes: int | None = None) -> Hits:
    """Local top-k of (query_id, groups, embedding) against (id, grp, embedding).

    Queries may have ``floors``, a similarity per group that their hits reach. Without
    it a collection of more than ``sample_bytes`` is searched in a part first, so that a task
    passes on only what reaches that part's top-k, not k rows per query.
    """
    sample_bytes = SAMPLE_BYTES if sample_bytes is None else sample_bytes
    out = "query_id {}, grp string, id {}, similarity double".format(
        queries.schema["query_id"].dataType.simpleString(),
        collection.schema["id"].dataType.simpleString(),
    )
    schema = pa.schema([
        ("query_id", _arrow_type(queries, "query_id")), ("grp", pa.string()),
        ("id", _arrow_type(collection, "id")), ("similarity", pa.float64()),
    ])
    # Also the size check: one row more than may be broadcast.
    queries = queries.where(F.col("embedding").isNotNull())
    head = queries.limit(max_queries + 1).toArrow()
    if head.num_rows == 0:
        return Hits(queries.sparkSession.createDataFrame([], out), True, ())
    lengths = pc.min_max(pc.list_value_length(head["embedding"])).as_py()
    if lengths["min"] != lengths["max"]:
        raise ValueError(f"query vectors of {lengths['min']} and of {lengths['max']} dimensions")
    dimensions = lengths["max"] or 1
    max_queries = min(max_queries, max(MAX_BROADCAST_VALUES // dimensions, 1))
    if head.num_rows <= max_queries:
        given = head["floors"].to_pylist() if "floors" in head.column_names else None
        groups, floors = _wanted(head["groups"].to_pylist(), given)
        if _ANY not in groups:
            # On a table partitioned by what makes up the group this skips directories.
            collection = collection.where(F.col("grp").isin(list(groups)))
        context = queries.sparkSession.sparkContext
        names, matrix = head["query_id"].to_pylist(), _matrix(head["embedding"].combine_chunks())
        block = context.broadcast((names, matrix, groups, floors))
        if given is None and estimated_bytes(collection) > sample_bytes:
            floors = _sampled_floors(collection, block, limits, schema, out)
            block = context.broadcast((names, matrix, groups, floors))

        def scan(batches):
            names, vectors, wanted, floors = block.value
            yield from _scan(batches, names, vectors, wanted, limits, schema, floors)

        searched = None if _ANY in groups else tuple(groups)
        return Hits(collection.mapInArrow(scan, out), True, searched)

    # Both sides large: tiles of bounded size, within each group its query blocks against its
    # slices. A crowded cell gets more tiles, and rows of cells nobody asked for move nowhere.
    floors = F.col("floors") if "floors" in queries.columns else F.transform("groups", lambda g: F.lit(float("-inf")))
    asked = queries.select("query_id", "embedding", F.inline(F.arrays_zip(F.col("groups").alias("grp"), floors.alias("floor"))))
    collection = collection.where(F.col("embedding").isNotNull())

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col("grp").alias("_of")).agg(F.count(F.lit(1)).alias(name))

    # One row per group: of the size of the limits and the cell model.
    sizes = counted(asked, "_asked").join(counted(collection, "_rows"), "_of").collect()
    if not sizes:
        return Hits(queries.sparkSession.createDataFrame([], out), False)
    grid = _grid([tuple(r) for r in sorted(sizes)], max_queries, tile_rows, dimensions)
    tiles = grid[-1][3] + grid[-1][1] * grid[-1][2]
    grid = F.broadcast(queries.sparkSession.createDataFrame(grid, "_of string, _blocks int, _slices int, _first int"))

    def share(n: str, column: str, salt: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), F.col(column)), F.col(n)).cast("int")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def placed(df: DataFrame, block: Column, slice_: Column) -> DataFrame:
        found = df.join(grid, F.col("grp") == F.col("_of")).select("*", block.alias("_block"))
        found = found.select("*", slice_.alias("_slice"))
        return found.withColumn("_tile", F.col("_first") + F.col("_block") * F.col("_slices") + F.col("_slice"))

    left = placed(asked, share("_blocks", "query_id", "q"), each("_slices")).select(
        "_tile", F.lit(False).alias("_row"), "grp", "query_id", F.lit(None).cast(collection.schema["id"].dataType).alias("id"),
        "embedding", "floor",
    )
    right = placed(collection, each("_blocks"), share("_slices", "id", "c")).select(
        "_tile", F.lit(True).alias("_row"), "grp", F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "id",
        "embedding", F.lit(None).cast("double").alias("floor"),
    )
    # A partition per tile: hashed keys would share partitions, and small ones would be coalesced.
    laid = left.unionByName(right).repartitionById(tiles, "_tile").sortWithinPartitions("_tile", "_row")

    def scan_tiles(batches):
        yield from _scan_tiles(batches, limits, schema)

    return Hits(laid.mapInArrow(scan_tiles, out), False)


def _ranked(candidates: DataFrame, keys: list[str], limit: Column) -> DataFrame:
    nearest = Window.partitionBy(*keys).orderBy(F.desc("similarity"), "id")
    return candidates.withColumn("rank", F.row_number().over(nearest)).where(
        F.col("rank") <= limit
    )


# --- top-k operators ----------------------------------------------------------------

def document_type(collection: DataFrame) -> Column:
    """The type, from the partition column where the table has one."""
    return F.col("type" if "type" in collection.columns else "metadata.type")


def filter_documents(collection: DataFrame, doc_type: str | None = None,
                     channel: str | None = None) -> DataFrame:
    """Equality on type and channel, to be applied before a search."""
    if doc_type:
        collection = collection.where(document_type(collection) == doc_type)
    if channel:
        collection = collection.where(F.col("metadata.channel_name") == channel)
    return collection


def search(collection: DataFrame, queries: DataFrame, k: int,
           min_similarity: float | None = None, max_queries: int = MAX_BROADCAST_QUERIES,
           tile_rows: int = TILE_ROWS, sample_bytes: int | None = None) -> Hits:
    """Exact cosine top-k: (query_id, id, similarity, rank) rows.

    ``collection`` has unique (id, embedding), ``queries`` (query_id, embedding).
    The collection is scanned where it lies; a task sends on k rows per query at most.
    """
    found, few, _ = _candidates(
        collection.select("id", F.lit(_ANY).alias("grp"), "embedding"),
        queries.select("query_id", "embedding", F.array(F.lit(_ANY)).alias("groups")),
        {_ANY: k}, max_queries, tile_rows, sample_bytes,
    )
    if min_similarity is not None:
        found = found.where(F.col("similarity") >= min_similarity)
    ranked = _ranked(found, ["query_id"], F.lit(k))
    return Hits(ranked.select("query_id", "id", "similarity", "rank"), few)


def search_by_type(collection: DataFrame, queries: DataFrame, limits: dict[str, int],
                   max_queries: int = MAX_BROADCAST_QUERIES,
                   tile_rows: int = TILE_ROWS) -> Hits:
    """Top-k per query and document type in one pass: (query_id, type, id, similarity, rank).

    ``collection`` has (id, type, embedding). ``queries`` has (query_id, types,
    embedding); a query only searches the types it lists.
    """
    found, few, _ = _candidates(
        collection.where(F.col("type").isin(list(limits))).select(
            "id", F.col("type").alias("grp"), "embedding"
        ),
        queries.select("query_id", "embedding", F.col("types").alias("groups")),
        limits, max_queries, tile_rows,
    )
    return Hits(_ranked_by_type(found.withColumnRenamed("grp", "type"), limits), few)


def _ranked_by_type(found: DataFrame, limits: dict[str, int]) -> DataFrame:
    allowed = F.create_map(*[F.lit(v) for pair in limits.items() for v in pair])[F.col("type")]
    return _ranked(found, ["query_id", "type"], allowed).select(
        "query_id", "type", "id", "similarity", "rank"
    )


# --- approximate top-k over k-means cells ---------------------------------------------

def _unit_vectors(vectors: DataFrame) -> DataFrame:
    dense = vectors.where(F.col("embedding").isNotNull()).withColumn(
        "_dense", array_to_vector("embedding")
    )
    return Normalizer(inputCol="_dense", outputCol="features").transform(dense).drop("_dense")


def fit_cells(vectors: DataFrame, n_cells: int, seed: int = 0):
    """K-means cells of unit vectors; ``vectors`` may be any part of the collection."""
    cells = KMeans(k=n_cells, seed=seed, maxIter=10, featuresCol="features", predictionCol="cell")
    return cells.fit(_unit_vectors(vectors).select("features"))


class Centres(NamedTuple):
    """Cells around given points, in place of a fitted model."""

    points: list[list[float]]

    def clusterCenters(self) -> np.ndarray:
        return _unit_rows(np.array(self.points, dtype=np.float64))


def assign_cells(vectors: DataFrame, model) -> DataFrame:
    """Adds ``cell``; write the result partitioned by it to prune later searches."""
    if isinstance(model, Centres):
        known = vectors.where(F.col("embedding").isNotNull())
        return known.withColumn("cell", _probed(model, 1, F.col("embedding"))[0].cast("int"))
    return model.transform(_unit_vectors(vectors)).drop("features")


def _probed(model, probes: int, vector: Column) -> Column:
    """The ``probes`` cells whose centres are closest, as text."""
    centres = np.array(model.clusterCenters())

    @F.pandas_udf("array<string>")
    def probe(vectors: pd.Series) -> pd.Series:
        points = _unit_rows(np.array(vectors.tolist(), dtype=np.float64))
        # Rounded, so that equal centres tie and the smaller number comes first.
        distance = np.round((centres**2).sum(axis=1) - 2 * points @ centres.T, _DECIMALS)
        order = np.argsort(distance, axis=1, kind="stable")[:, :probes]
        return pd.Series([[str(c) for c in row] for row in order])

    return probe(vector)


def search_cells(celled: DataFrame, queries: DataFrame, model, k: int, probes: int,
                 max_queries: int = MAX_BROADCAST_QUERIES, tile_rows: int = TILE_ROWS) -> Hits:
    """Top-k among the rows of each query's ``probes`` closest cells.

    Cells are read in place, never gathered: a cell with a third of the rows is
    searched by all the tasks that hold a part of it.
    """
    found, few, _ = _candidates(
        celled.select("id", F.col("cell").cast("string").alias("grp"), "embedding"),
        queries.select(
            "query_id", "embedding", _probed(model, probes, F.col("embedding")).alias("groups")
        ),
        {_ANY: k}, max_queries, tile_rows,
    )
    ranked = _ranked(found, ["query_id"], F.lit(k))
    return Hits(ranked.select("query_id", "id", "similarity", "rank"), few)


def search_cells_by_type(celled: DataFrame, queries: DataFrame, model, limits: dict[str, int],
                         probes: int, max_queries: int = MAX_BROADCAST_QUERIES,
                         tile_rows: int = TILE_ROWS) -> Hits:
    """``search_by_type`` within each query's closest cells; ``celled`` has type and cell."""
    cells = _probed(model, probes, F.col("embedding"))
    asked = queries.select("query_id", "embedding", "types", cells.alias("cells"))
    groups = F.flatten(F.transform(
        "types", lambda t: F.transform("cells", lambda c: F.concat(t, F.lit("/"), c))
    ))
    found, few, searched = _candidates(
        celled.where(F.col("type").isin(list(limits))).select(
            "id", F.concat("type", F.lit("/"), "cell").alias("grp"), "embedding"
        ),
        asked.select("query_id", "embedding", groups.alias("groups")),
        {_ANY: max(limits.values())}, max_queries, tile_rows,
    )
    typed = found.withColumn("type", F.substring_index("grp", "/", 1)).drop("grp")
    return Hits(_ranked_by_type(typed, limits), few, searched)


# --- collection upkeep ------------------------------------------------------------------

def message_documents(messages: DataFrame, positional_ids: bool = False,
                      true_types: bool = False) -> DataFrame:
    """Messages as (id, document, metadata), without blank ones and bots.

    Ids are hashes by default; ``positional_ids`` numbers all messages in export
    order first, so gaps stay where rows are left out.
    """
    def filled(column: str, default: str) -> Column:
        return F.coalesce(F.col(column), F.lit(default))

    if positional_ids:
        messages = global_index(messages, ["source", "file_name", "ordinal"], "_n")
        doc_id = F.concat(F.lit("discord_msg_"), F.col("_n"))
        message_id = F.coalesce("message_id", F.concat(F.lit("msg_"), F.col("_n")))
    else:
        key = F.concat_ws("|", *[
            F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
            ("source", "conv_key", "message_id", "file_name", "ordinal")
        ])
        doc_id = F.sha2(key, 256)
        message_id = F.coalesce("message_id", F.concat(F.lit("msg_"), doc_id))
    kind = F.lit(fixed.MESSAGE_TYPE)
    channel = F.col("channel_name")
    if true_types:
        other = F.col("source") == "instagram"
        kind = F.when(other, "instagram_message").otherwise(kind)
        channel = F.coalesce(channel, F.col("conversation_name"))
    described = metadata(
        message_id=message_id, author_id=filled("author_id", ""),
        author_name=filled("author_name", "Unknown"),
        channel_name=F.coalesce(channel, F.lit("Unknown")),
        guild_name=filled("guild_name", "Unknown"),
        timestamp=F.coalesce("ts_raw", F.lit("")), type=kind,
    )
    kept = messages.where(from_person() & ~is_blank(F.col("content")))
    return kept.select(
        doc_id.alias("id"),
        line(F.col("author_name"), py_strip(F.col("content"))).alias("document"),
        described.alias("metadata"),
    )


def new_vectors(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming rows whose id is not in the collection yet."""
    return incoming.join(existing.select("id"), "id", "left_anti")
