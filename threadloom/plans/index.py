"""Messages and documentation to the vector collection."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.sections import doc_sections, section_documents
from threadloom.operators.vectors import (
    Centres,
    assign_cells,
    document_type,
    embed_hashed,
    fit_cells,
    message_documents,
)
from threadloom.sinks.snapshots import NOTHING, add_to_snapshot, read_snapshot, replace_snapshot, version
from threadloom.sinks.tables import write_cells
from threadloom.sources.files import doc_files

Embed = Callable[[DataFrame, str], DataFrame]


class Ledger(NamedTuple):
    """Vectors by the hash of their text and the version of the model that made them.

    A text is embedded once per model version, whichever document holds it and however
    often the collection is rebuilt.
    """

    path: str
    model: str


def embedded(documents: DataFrame, embed: Embed = embed_hashed, ledger: Ledger | None = None) -> DataFrame:
    """``documents`` with ``embedding``; with a ledger only texts that it lacks reach the model.

    A document of null has no vector of its own in the ledger and is embedded as empty text.
    """
    if ledger is None:
        return embed(documents, "document")
    spark = documents.sparkSession
    hashed = documents.withColumn("text_hash", F.sha2(F.coalesce("document", F.lit("")), 256))
    texts = hashed.select("text_hash", F.coalesce("document", F.lit("")).alias("document")).dropDuplicates(["text_hash"])
    if version(spark, ledger.path) != NOTHING:
        known = read_snapshot(spark, ledger.path).where(F.col("model") == ledger.model)
        texts = texts.join(known.select("text_hash"), "text_hash", "left_anti")
    made = embed(texts, "document").select(
        F.concat_ws("/", F.lit(ledger.model), "text_hash").alias("entry"), F.lit(ledger.model).alias("model"), "text_hash", "embedding")
    add_to_snapshot(made, ledger.path, "entry", ["model"])
    vectors = read_snapshot(spark, ledger.path).where(F.col("model") == ledger.model)
    return hashed.join(vectors.select("text_hash", "embedding"), "text_hash").drop("text_hash")


def _typed(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("type", F.col("metadata.type"))


def build_collection(messages: DataFrame, path: str, embed: Embed = embed_hashed,
                     ledger: Ledger | None = None) -> DataFrame:
    """Rebuilds the collection from the messages. ``embed(df, column)`` adds ``embedding``.

    The collection is kept in versions: searches that have opened it go on with theirs.
    """
    replace_snapshot(_typed(embedded(message_documents(messages), embed, ledger)), path, ["type"])
    return read_snapshot(messages.sparkSession, path)


def add_docs(spark: SparkSession, docs_root: str, path: str,
             embed: Embed = embed_hashed, ledger: Ledger | None = None) -> DataFrame:
    """Adds the sections of a documentation tree that the collection lacks."""
    documents = section_documents(doc_sections(doc_files(spark, docs_root)))
    add_to_snapshot(_typed(embedded(documents, embed, ledger)), path, "id", ["type"])
    return read_snapshot(spark, path)


def build_cells(collection: DataFrame, path: str, n_cells: int, fit_on: DataFrame | None = None,
                seed: int = 0, centres: Centres | None = None):
    """Stores a collection by type and k-means cell and returns the cell model.

    With ``centres`` nothing is fitted. ``fit_on`` may be a part of the collection when fitting on all of it takes too long;
    every row gets its cell either way.
    """
    model = centres or fit_cells(collection if fit_on is None else fit_on, n_cells, seed)
    typed = collection.withColumn("type", document_type(collection))
    write_cells(assign_cells(typed, model), path)
    return model


def collection_size(collection: DataFrame) -> DataFrame:
    return collection.agg(F.count(F.lit(1)).alias("n_documents"))
