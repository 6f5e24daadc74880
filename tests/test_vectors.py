"""Top-k against brute force, cells, embeddings and collection upkeep."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import fixed
from threadloom.functions.metadata import FIELDS, metadata
from threadloom.operators import retrieval, vectors
from threadloom.operators.messages import MESSAGE_COLUMNS, MESSAGE_SCHEMA
from threadloom.plans import index
from threadloom.sinks import tables as sinks


def vectors_with_copies(n=240, dim=8, seed=0):
    """A third of the rows are copies of one vector, one is zero."""
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(n, dim)).astype(np.float32)
    made[: n // 3] = made[0]
    made[n - 1] = 0
    return made


def tables(spark, n=240, n_queries=40, text_ids=False):
    made = vectors_with_copies(n)
    name = (lambda i: f"id{i:04d}") if text_ids else (lambda i: i)
    kind = "string" if text_ids else "bigint"
    order = np.random.default_rng(1).permutation(n)
    collection = spark.createDataFrame(
        [(name(int(i)), made[i].tolist(), "ab"[i % 2]) for i in order],
        f"id {kind}, embedding array<float>, type string",
    ).repartition(5)
    asked = vectors_with_copies(n_queries, seed=5)
    queries = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, embedding array<float>"
    )
    return collection, queries, made, asked, name


def unit(rows):
    rows = rows.astype(np.float64)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def brute(made, asked, k, name, rows=None):
    sims = np.round(unit(asked) @ unit(made).T, 9)
    rows = np.arange(len(made)) if rows is None else rows
    found = set()
    for q in range(len(asked)):
        best = sorted(rows, key=lambda i: (-sims[q, i], i))[:k]
        found |= {(q, name(int(i)), rank + 1) for rank, i in enumerate(best)}
    return found


def triples(hits):
    return {(r["query_id"], r["id"], r["rank"]) for r in hits.rows.collect()}


@pytest.mark.parametrize("text_ids", [False, True])
@pytest.mark.parametrize("k", [1, 4])
def test_search(spark, k, text_ids):
    collection, queries, made, asked, name = tables(spark, text_ids=text_ids)
    hits = vectors.search(collection, queries, k)
    assert hits.few and triples(hits) == brute(made, asked, k, name)


@pytest.mark.parametrize("batch", [7, 10_000])
def test_search_does_not_depend_on_batches(spark, batch):
    collection, queries, made, asked, name = tables(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = triples(vectors.search(collection, queries, 5))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == brute(made, asked, 5, name)


def test_tiles_give_the_same(spark):
    collection, queries, made, asked, name = tables(spark)
    hits = vectors.search(collection, queries, 4, max_queries=9, tile_rows=50)
    assert not hits.few and triples(hits) == brute(made, asked, 4, name)


def test_tiles_of_one_table_with_itself(spark):
    collection, _, made, _, name = tables(spark, n=60)
    asked = collection.select(F.col("id").alias("query_id"), "embedding")
    hits = vectors.search(collection, asked, 3, max_queries=7, tile_rows=20)
    assert triples(hits) == brute(made, made, 3, name)


def test_fewer_rows_than_k(spark):
    collection, queries, made, asked, name = tables(spark, n=3)
    assert triples(vectors.search(collection, queries, 10)) == brute(made, asked, 10, name)


def test_no_queries_and_null_vectors(spark):
    collection, queries, made, asked, name = tables(spark)
    assert vectors.search(collection, queries.limit(0), 3).rows.collect() == []
    holed = collection.unionByName(spark.createDataFrame(
        [(-1, None, "a")], "id bigint, embedding array<float>, type string"
    ))
    assert triples(vectors.search(holed, queries, 3)) == brute(made, asked, 3, name)


def test_min_similarity(spark):
    collection, queries, *_ = tables(spark)
    every = vectors.search(collection, queries, 5).rows.where("similarity >= 0.4").collect()
    some = vectors.search(collection, queries, 5, min_similarity=0.4).rows.collect()
    assert sorted(map(tuple, every)) == sorted(map(tuple, some)) and some


@pytest.mark.parametrize("options", [{}, {"max_queries": 9, "tile_rows": 50}])
def test_search_by_type(spark, options):
    collection, queries, made, asked, name = tables(spark)
    types = F.when(F.col("query_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(
        F.array(F.lit("a"))
    )
    hits = vectors.search_by_type(
        collection, queries.withColumn("types", types), {"a": 3, "b": 2}, **options
    )
    found = {(r["query_id"], r["id"], r["rank"]) for r in hits.rows.where("type = 'a'").collect()}
    assert found == brute(made, asked, 3, name, range(0, len(made), 2))
    found = {(r["query_id"], r["id"], r["rank"]) for r in hits.rows.where("type = 'b'").collect()}
    want = brute(made, asked, 2, name, range(1, len(made), 2))
    assert found == {t for t in want if t[0] % 3 == 0}


def test_cells(spark):
    collection, queries, made, asked, name = tables(spark)
    model = vectors.fit_cells(collection, 6, seed=2)
    celled = vectors.assign_cells(collection, model)
    assert celled.count() == collection.count()
    exact = brute(made, asked, 5, name)
    assert triples(vectors.search_cells(celled, queries, model, 5, 6)) == exact
    near = triples(vectors.search_cells(celled, queries, model, 5, 3))
    assert near == triples(
        vectors.search_cells(celled, queries, model, 5, 3, max_queries=9, tile_rows=50)
    )
    pairs, wanted = {t[:2] for t in near}, {t[:2] for t in exact}
    assert len(pairs & wanted) / len(wanted) > 0.6


def test_probed_cells_prune_directories(spark, tmp_path):
    collection, queries, made, asked, name = tables(spark)
    path = str(tmp_path / "celled")
    model = index.build_cells(collection, path, 6, fit_on=collection.where("id > 20"), seed=2)
    celled = spark.read.parquet(path)
    one = queries.where("query_id = 30").withColumn("types", F.array(F.lit("a")))
    hits = vectors.search_cells_by_type(celled, one, model, {"a": 3, "b": 2}, 1)
    assert hits.rows.count() == 3
    plan = hits.rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    every = queries.withColumn("types", F.array(F.lit("a"), F.lit("b")))
    wide = vectors.search_cells_by_type(celled, every, model, {"a": 3, "b": 2}, 6)
    exact = vectors.search_by_type(celled, every, {"a": 3, "b": 2})
    assert sorted(map(tuple, wide.rows.collect())) == sorted(map(tuple, exact.rows.collect()))


def test_hashed_embedding(spark):
    rows = spark.createDataFrame(
        [(0, "a b"), (1, "B  A"), (2, ""), (3, None), (4, "c d e")], "i int, text string"
    )
    made = {r["i"]: r["embedding"] for r in vectors.embed_hashed(rows, "text", dimensions=64).collect()}
    assert all(len(v) == 64 for v in made.values())
    assert np.isclose(np.linalg.norm(made[4]), 1) and sum(map(abs, made[0])) > 0
    assert np.allclose(np.dot(made[0], made[0]), 1)


def test_weighted_embedding(spark):
    """A word of every document weighs nothing."""
    rows = spark.createDataFrame([(0, "all one"), (1, "all two"), (2, "all")], "i int, text string")
    weights = vectors.fit_word_weights(rows, "text", 64)
    made = {
        r["i"]: np.array(r["embedding"])
        for r in vectors.embed_hashed(rows, "text", dimensions=64, weights=weights).collect()
    }
    assert np.isclose(np.linalg.norm(made[0]), 1) and np.isclose(made[0] @ made[1], 0)
    assert not made[2].any()


def test_long_vectors_lower_the_broadcast_limit(spark, monkeypatch):
    collection, queries, made, asked, name = tables(spark)
    monkeypatch.setattr(vectors, "MAX_BROADCAST_VALUES", 8 * 10)
    hits = vectors.search(collection, queries, 4, tile_rows=100)
    assert not hits.few and triples(hits) == brute(made, asked, 4, name)


def test_user_model(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    rows = spark.createDataFrame([("abc",), (None,), ("x" * 9,)], "text string")
    made = rows.withColumn("v", vectors.embed_with(load, F.col("text"), batch_size=2))
    assert sorted(r["v"] for r in made.collect()) == [[0.0, 1.0], [3.0, 1.0], [9.0, 1.0]]


def messages(spark):
    rows = [
        dict(source=None, file_name="f1", ordinal=0, author_name="ann", content=" hi ",
             message_id="m0", channel_name="c", guild_name="g", ts_raw="T", author_id="1"),
        dict(source=None, file_name="f1", ordinal=1, author_name="bot", content="x", is_bot=True),
        dict(source=None, file_name="f1", ordinal=2, author_name="ann", content=" \n"),
        dict(source="instagram", file_name="f0", ordinal=0, content="yo", conversation_name="z"),
    ]
    return spark.createDataFrame(
        [tuple(r.get(c) for c in MESSAGE_COLUMNS) for r in rows], MESSAGE_SCHEMA
    )


def test_message_documents(spark):
    made = vectors.message_documents(messages(spark), positional_ids=True).orderBy("id").collect()
    assert [(r["id"], r["document"]) for r in made] == [
        ("discord_msg_0", "ann: hi"), ("discord_msg_3", "Unknown: yo"),
    ]
    assert made[0]["metadata"].asDict() == dict(
        dict.fromkeys(FIELDS), message_id="m0", author_id="1", author_name="ann",
        channel_name="c", guild_name="g", timestamp="T", type="discord_message",
    )
    assert made[1]["metadata"].asDict() == dict(
        dict.fromkeys(FIELDS), message_id="msg_3", author_id="", author_name="Unknown",
        channel_name="Unknown", guild_name="Unknown", timestamp="", type="discord_message",
    )
    typed = vectors.message_documents(messages(spark), true_types=True).collect()
    assert {(r["metadata"]["type"], r["metadata"]["channel_name"]) for r in typed} == {
        ("discord_message", "c"), ("instagram_message", "z"),
    }


def test_collection_upkeep(spark, tmp_path):
    path = str(tmp_path / "collection")
    docs = tmp_path / "docs" / "source" / "a"
    docs.mkdir(parents=True)
    (docs / "g.md").write_text("# Gyro\n" + "turn the gyro " * 9 + "\n# Arm\n" + "lift the arm " * 9)
    built = index.build_collection(messages(spark), path)
    assert index.collection_size(built).collect()[0][0] == 2
    assert index.collection_size(index.build_collection(messages(spark), path)).collect()[0][0] == 2
    for _ in range(2):
        grown = index.add_docs(spark, str(tmp_path / "docs"), path)
    assert grown.count() == 4 and grown.select("id").distinct().count() == 4
    assert {r["type"] for r in grown.select("type").distinct().collect()} == {
        fixed.MESSAGE_TYPE, fixed.DOCS_TYPE,
    }
    asked = vectors.embed_hashed(
        spark.createDataFrame([("q", "lift the arm")], "query_id string, text string"), "text"
    )
    found = retrieval.retrieve(grown, asked, 1, doc_type=fixed.DOCS_TYPE, filtered=True).collect()
    assert found[0]["context"].startswith("[WPILib] Arm: # Arm\n\nlift the arm")


def test_adding_to_nothing_creates(spark, tmp_path):
    path = str(tmp_path / "new")
    row = vectors.embed_hashed(vectors.message_documents(messages(spark)), "document")
    sinks.add_to_collection(row, path)
    assert spark.read.parquet(path).count() == 2


def collection(spark):
    rows = [
        (1, "ann: hi", [1.0, 0.0], fixed.MESSAGE_TYPE, "c", None),
        (2, "bob: yo", [0.9, 0.1], fixed.MESSAGE_TYPE, None, None),
        (3, "d" * 300, [0.8, 0.2], fixed.DOCS_TYPE, None, "Title"),
        (4, "short", [0.7, 0.3], fixed.DOCS_TYPE, None, None),
        (5, "other", [0.6, 0.4], "else", None, None),
        (6, "cat: far", [0.0, 1.0], fixed.MESSAGE_TYPE, "d", None),
        (7, "dog: farther", [-1.0, 0.0], fixed.MESSAGE_TYPE, "d", None),
    ]
    made = spark.createDataFrame(
        rows, "id int, document string, embedding array<float>, t string, c string, h string"
    )
    described = metadata(type=F.col("t"), channel_name=F.col("c"), title=F.col("h"))
    return made.select("id", "document", "embedding", described.alias("metadata"))


def asked(spark, *texts):
    return spark.createDataFrame(
        [(i, t, [1.0, 0.0]) for i, t in enumerate(texts)],
        "query_id int, text string, embedding array<float>",
    )


def test_context_lines(spark):
    def lines(**options):
        rows = retrieval.retrieve(collection(spark), asked(spark, "q"), 5, **options)
        return [r["context"] for r in rows.orderBy("rank").collect()]

    assert lines() == [
        "[c] ann: hi", "[Unknown] bob: yo", "[WPILib Docs: Title] " + "d" * 200 + "...",
        "[WPILib Docs: Unknown] short...", "other",
    ]
    assert lines(filtered=True) == [
        "[c] ann: hi", "[None] bob: yo", "[WPILib] Title: " + "d" * 150 + "...",
        "[WPILib] None: short...", "other",
    ]
    assert lines(doc_type=fixed.MESSAGE_TYPE, channel="d") == ["[d] cat: far", "[d] dog: farther"]


@pytest.mark.parametrize("options", [{}, {"max_queries": 1}])
def test_mixed_context(spark, options):
    found = retrieval.mixed_context(
        collection(spark), asked(spark, "hello", "my ROBOT", None), **options
    )
    lists = {r["query_id"]: r["contexts"] for r in found.collect()}
    messages = ["[c] ann: hi", "[None] bob: yo", "[d] cat: far"]
    docs = ["[WPILib] Title: " + "d" * 150 + "...", "[WPILib] None: short..."]
    assert lists == {0: messages, 1: messages + docs, 2: messages}


@pytest.mark.parametrize("word", fixed.DOCS_KEYWORDS)
def test_keywords(column_of, word):
    texts = [f"a{word.upper()}b", word[:-1] + "_", "nothing"]
    assert column_of(retrieval.wants_docs, texts) == [True, False, False]


@pytest.mark.parametrize("text_ids", [False, True])
def test_tiles_of_any_size_give_the_same(spark, monkeypatch, text_ids):
    """Several blocks and slices per group, more queries than a block holds."""
    collection, queries, made, asked, name = tables(spark, text_ids=text_ids)
    monkeypatch.setattr(vectors, "LEAST_PAIRS", 500)
    monkeypatch.setattr(vectors, "MOST_PAIRS", 500)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(vectors, "_QUERY_STRIP", 3)
    monkeypatch.setattr(vectors, "_ROW_CHUNK", 32)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        hits = vectors.search(collection, queries, 4, max_queries=1, tile_rows=50)
        assert not hits.few and triples(hits) == brute(made, asked, 4, name)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _passed_on(collection, queries, k):
    return vectors._candidates(
        collection.select("id", F.lit("*").alias("grp"), "embedding"),
        queries.select("query_id", "embedding", F.array(F.lit("*")).alias("groups")), {"*": k}, 2, 10,
    ).rows


def test_small_tiles_are_not_cut_further(spark):
    """Tiles pass on k rows per query and slice: slices of ten rows would pass on nearly everything."""
    collection, queries, made, asked, name = tables(spark)
    assert _passed_on(collection, queries, 4).count() <= 2 * 4 * len(asked)


def test_every_tile_has_its_task(spark, monkeypatch):
    """Tiles are of little data and much work, so they are not to be coalesced by size."""
    monkeypatch.setattr(vectors, "LEAST_PAIRS", 600)
    monkeypatch.setattr(vectors, "MOST_PAIRS", 600)
    collection, queries, made, asked, name = tables(spark)
    found = _passed_on(collection, queries, 4).withColumn("task", F.spark_partition_id())
    assert found.select("task").distinct().count() >= len(made) * len(asked) / 1200


def test_tiles_grow_slower_than_pairs():
    for n in (10_000, 100_000, 600_000):
        ((_, blocks, slices, _),) = vectors._grid([("*", n, n)], 50, 50, 64)
        assert blocks * vectors.BLOCK_QUERIES >= n and blocks * slices <= 300
        assert n * (blocks + slices) <= 40 * n
    cells = [(str(i), 450_000, 37_500) for i in range(16)]
    grid = vectors._grid(cells, 50, 50, 64)
    assert sum(b * s for _, b, s, _ in grid) <= 400
    assert [first for *_, first in grid] == [sum(b * s for _, b, s, _ in grid[:i]) for i in range(16)]


def test_products_held_are_few(spark):
    """A task's leaders see rows by chunks, whatever the size of a batch."""
    rng = np.random.default_rng(3)
    points = vectors._unit_rows(rng.normal(size=(20_000, 8)))
    leaders = vectors._Leaders(points[:1024], 5, np.full(1024, -np.inf))
    ids = np.array(list(map(int, range(len(points)))), dtype=object)
    tracemalloc.start()
    try:
        leaders.offer(ids, points)
        assert tracemalloc.get_traced_memory()[1] < 80_000_000
    finally:
        tracemalloc.stop()
