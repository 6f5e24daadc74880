"""Versioned tables under concurrent readers and writers, and vectors kept by content."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators import vectors
from threadloom.plans import index
from threadloom.sinks import snapshots


def rows(spark, *ids, text="x"):
    return spark.createDataFrame([(i, f"{text}{i}", "ab"[i % 2]) for i in ids], "id int, text string, type string")


def held(df):
    return sorted((r["id"], r["text"]) for r in df.collect())


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.replace_snapshot(rows(spark, 1, 2), path, ["type"])
    opened = snapshots.read_snapshot(spark, path)
    snapshots.replace_snapshot(rows(spark, 3, text="y"), path, ["type"])
    assert held(opened) == [(1, "x1"), (2, "x2")]
    assert held(snapshots.read_snapshot(spark, path)) == [(3, "y3")]
    assert held(snapshots.read_snapshot(spark, path, 1)) == held(opened)
    plan = snapshots.read_snapshot(spark, path).where("type = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(type" in plan
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, path, 9)
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, str(tmp_path / "none"))


def test_adds_bring_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.add_to_snapshot(rows(spark, 1, 1, 2), path, "id", ["type"])
    snapshots.add_to_snapshot(rows(spark, 2, 3, text="y"), path, "id", ["type"])
    assert held(snapshots.read_snapshot(spark, path)) == [(1, "x1"), (2, "x2"), (3, "y3")]
    snapshots.add_to_snapshot(rows(spark), path, "id", ["type"])
    assert snapshots.read_snapshot(spark, path).count() == 3


def test_two_adds_at_once_leave_one_row(spark, tmp_path):
    """Another add, then a rebuild, are published while this one is between writing and publishing."""
    path = str(tmp_path / "t")
    snapshots.add_to_snapshot(rows(spark, 1), path, "id", ["type"])
    others = [
        lambda: snapshots.add_to_snapshot(rows(spark, 2, 3, text="other"), path, "id", ["type"]),
        lambda: snapshots.replace_snapshot(rows(spark, 3, 4, text="new"), path, ["type"]),
    ]
    done = snapshots.add_to_snapshot(
        rows(spark, 1, 2, 5), path, "id", ["type"], between=lambda: others.pop(0)() if others else None)
    assert done.number == 4
    assert held(snapshots.read_snapshot(spark, path)) == [(1, "x1"), (2, "x2"), (3, "new3"), (4, "new4"), (5, "x5")]
    assert held(snapshots.read_snapshot(spark, path, 2)) == [(1, "x1"), (2, "other2"), (3, "other3")]


def test_an_unfinished_version_is_not_there(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.replace_snapshot(rows(spark, 1), path, ["type"])
    (tmp_path / "t/_versions/.cut-off").write_text('{"folders": ["a')
    assert held(snapshots.read_snapshot(spark, path)) == [(1, "x1")]
    first = snapshots.version(spark, path)
    assert snapshots.publish(spark, path, first, ("b",)) and snapshots.version(spark, path) == (2, ("b",))
    assert not snapshots.publish(spark, path, first, ("c",)) and snapshots.version(spark, path) == (2, ("b",))
    assert snapshots.versions(spark, path) == [1, 2]


def test_old_versions_are_forgotten(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(3):
        snapshots.replace_snapshot(rows(spark, i), path, ["type"])
    snapshots.add_to_snapshot(rows(spark, 7), path, "id", ["type"])
    snapshots.write_folder(rows(spark, 8), path, ["type"])  # of a writer that was cut off
    assert snapshots.forget(spark, path, keep=2) == 3
    assert snapshots.versions(spark, path) == [3, 4]
    assert held(snapshots.read_snapshot(spark, path)) == [(2, "x2"), (7, "x7")]
    assert held(snapshots.read_snapshot(spark, path, 3)) == [(2, "x2")]


def test_texts_reach_the_model_once(spark, tmp_path):
    """The number of texts embedded, over rebuilds, repeated texts and another model version."""
    asked = spark.sparkContext.accumulator(0)

    def load():
        def encode(texts):
            asked.add(len(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    def embed(df, column):
        return df.withColumn("embedding", vectors.embed_with(load, F.col(column)))

    def documents(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "id int, document string")

    ledger = index.Ledger(str(tmp_path / "ledger"), "v1")
    first = index.embedded(documents("a", "bb", "bb", "a", None, ""), embed, ledger)
    assert {r["id"]: r["embedding"][0] for r in first.collect()} == {0: 1, 1: 2, 2: 2, 3: 1, 4: 0, 5: 0}
    assert asked.value == 3
    again = index.embedded(documents("bb", "ccc", "a"), embed, ledger)
    assert {r["id"]: r["embedding"][0] for r in again.collect()} == {0: 2, 1: 3, 2: 1}
    assert asked.value == 4
    index.embedded(documents("bb", "a"), embed, ledger).collect()
    assert asked.value == 4
    other = index.embedded(documents("bb"), embed, ledger._replace(model="v2"))
    assert other.collect()[0]["embedding"] == [2.0, 1.0] and asked.value == 5
    assert index.embedded(documents("a"), embed).count() == 1
