"""Writers for messages, summaries, chat datasets and vector collections.

Partition directories are filled by the tasks that hold the rows, or after a rebalance that
splits a hot directory over several files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.messages import YEAR_COLUMN
from threadloom.operators.vectors import new_vectors
from threadloom.runtime import path_exists
from threadloom.sinks.snapshots import replace_parts


def write_messages(messages: DataFrame, path: str) -> None:
    """Replaces the table's rows of the sources present; a re-run duplicates nothing.

    Laid out by source and year, and by time inside, for the year filter; readers of earlier
    versions keep theirs. ``read_messages`` reads it.
    """
    dated = messages.drop(YEAR_COLUMN).withColumn(YEAR_COLUMN, F.year("ts"))
    laid_out = dated.hint("rebalance", "source", YEAR_COLUMN).sortWithinPartitions("source", YEAR_COLUMN, "ts")
    replace_parts(laid_out, path, ["source", YEAR_COLUMN])


CONVERSATION_BUCKETS = 64


def write_by_conversation(messages: DataFrame, path: str, buckets: int = CONVERSATION_BUCKETS) -> None:
    """Conversations kept together: a directory per source and bucket of keys, sorted inside.

    A reader of one conversation reads its bucket (``conversation_bucket``). Keys may be of
    any length and number; a bucket with much in it gets several files.
    """
    bucketed = messages.withColumn("bucket", conversation_bucket(F.col("conv_key"), buckets))
    order = [c for c in ("source", "bucket", "conv_key", "ts", "file_name", "ordinal") if c in bucketed.columns]
    (
        bucketed.hint("rebalance", "source", "bucket").sortWithinPartitions(*order)
        .write.mode("overwrite").partitionBy("source", "bucket").json(path)
    )


def conversation_bucket(key: Column, buckets: int = CONVERSATION_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def write_chat_datasets(split: DataFrame, path: str) -> None:
    """Chat examples with a ``split`` column to ``split=train`` and ``split=val``."""
    split.write.mode("overwrite").partitionBy("split").json(path)


def _typed(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("type", F.col("metadata.type"))


def rebuild_collection(vectors: DataFrame, path: str) -> None:
    """Replaces the whole collection."""
    _typed(vectors).write.mode("overwrite").partitionBy("type").parquet(path)


def add_to_collection(vectors: DataFrame, path: str) -> None:
    """Appends the rows whose id is new, creating the collection when missing."""
    spark = vectors.sparkSession
    vectors = vectors.dropDuplicates(["id"])
    if path_exists(spark, path):
        vectors = new_vectors(spark.read.parquet(path), vectors)
    _typed(vectors).write.mode("append").partitionBy("type").parquet(path)


def write_cells(celled: DataFrame, path: str) -> None:
    """Replaces a collection stored by type and cell.

    Rebalanced first: few files for small cells, several for one that holds much.
    """
    (
        celled.hint("rebalance", "type", "cell")
        .write.mode("overwrite").partitionBy("type", "cell").parquet(path)
    )
