"""Certified cell search against the exact one, the cells it reads and the rows tasks pass on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_vectors import tables, triples
from threadloom.operators import cells, vectors
from threadloom.plans import index


def clustered(spark, n=1200, dim=12, clusters=20, seed=4):
    """Tight clusters; the first holds a third of the rows."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    of = np.where(np.arange(n) % 3 == 0, 0, rng.integers(0, clusters, n))
    made = centres[of] + 0.02 * rng.normal(size=(n, dim))
    rows = [(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(made)]
    collection = spark.createDataFrame(rows, "id long, embedding array<double>, type string").repartition(6)
    return collection, collection.where("id % 9 = 0").select(F.col("id").alias("query_id"), "embedding")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    collection, queries = clustered(spark)
    path = str(tmp_path_factory.mktemp("cells") / "celled")
    model = index.build_cells(collection, path, 20, seed=1)
    celled = spark.read.parquet(path)
    return collection, queries, celled, cells.cell_bounds(celled, model)


def test_equals_the_exact_search_with_fewer_cells(spark, stored):
    collection, queries, celled, bounds = stored
    one = queries.where("query_id % 27 = 0 and query_id % 2 = 1")
    found = cells.search_cells_exact(celled, one, bounds, 5, 1)
    assert triples(found) == triples(vectors.search(collection, one, 5))
    every = cells.search_cells_exact(celled, queries, bounds, 5, 1)
    assert triples(every) == triples(vectors.search(collection, queries, 5))
    single = queries.where("query_id = 9")
    read = cells.search_cells_exact(celled, single, bounds, 5, 1)
    assert len(read.groups) <= 3 and len(triples(read)) == 5


def test_tiles_give_the_same(spark, stored):
    collection, queries, celled, bounds = stored
    found = cells.search_cells_exact(celled, queries, bounds, 5, 2, max_queries=20, tile_rows=100)
    assert not found.few and triples(found) == triples(vectors.search(collection, queries, 5))


def test_by_type(spark, stored):
    collection, queries, celled, bounds = stored
    limits = {"a": 4, "b": 2, "c": 3}
    asked = queries.withColumn("types", F.when(F.col("query_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("x")))
                               .otherwise(F.array(F.lit("b"))))
    found = cells.search_cells_by_type_exact(celled, asked, bounds, limits, 1)
    exact = vectors.search_by_type(collection, asked, limits)
    assert sorted(map(tuple, found.rows.collect())) == sorted(map(tuple, exact.rows.select(*found.rows.columns).collect()))


def test_copies_zero_vectors_and_more_hits_than_rows(spark):
    """A third of the rows are copies, one is zero; cells around few points, some without rows."""
    collection, queries, made, asked, name = tables(spark)
    zero = [(99, [0.0] * 8), (98, None)]
    queries = queries.unionByName(spark.createDataFrame(zero, "query_id int, embedding array<float>"))
    points = [made[0].tolist(), made[0].tolist(), made[120].tolist(), [0.0] * 8, (-made[120]).tolist()]
    celled = vectors.assign_cells(collection, vectors.Centres(points))
    bounds = cells.cell_bounds(celled, vectors.Centres(points))
    for k in (5, 300):
        found = cells.search_cells_exact(celled, queries, bounds, k, 1)
        assert triples(found) == triples(vectors.search(collection, queries, k))


def test_stored_bounds(spark, stored, tmp_path):
    *_, bounds = stored
    cells.write_bounds(spark, bounds, str(tmp_path / "bounds"))
    again = cells.read_bounds(spark, str(tmp_path / "bounds"))
    assert all(np.array_equal(a, b) for a, b in zip(bounds, again))


def test_a_bound_holds_for_every_row(spark, stored):
    _, queries, celled, bounds = stored
    rows = celled.select("cell", "embedding").collect()
    points = vectors._unit_rows(np.array([r["embedding"] for r in queries.collect()]))
    sims = points @ vectors._unit_rows(np.array([r["embedding"] for r in rows])).T
    highest = bounds.ceilings(points)
    for j, r in enumerate(rows):
        assert (sims[:, j] <= highest[:, r["cell"]] + 1e-9).all()


def test_a_sample_lowers_what_tasks_pass_on(spark, monkeypatch):
    """The first task's top-k is the floor of all: same result, fewer rows from the others."""
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(4000, 6)))]
    collection = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(40)
    queries = collection.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")

    def passed_on(sample_bytes):
        counted = spark.sparkContext.accumulator(0)
        known = vectors._scan

        def scan(*args):
            for batch in known(*args):
                counted.add(batch.num_rows)
                yield batch

        monkeypatch.setattr(vectors, "_scan", scan)
        found = triples(vectors.search(collection, queries, 10, sample_bytes=sample_bytes))
        monkeypatch.setattr(vectors, "_scan", known)
        return found, counted.value

    monkeypatch.setattr(vectors, "SAMPLE_STEP", 5)
    plain, many = passed_on(1 << 200)
    floored, few = passed_on(0)
    assert floored == plain and many == 40 * 40 * 10
    assert few < many / 2
