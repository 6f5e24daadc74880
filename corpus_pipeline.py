"""The corpus pipeline: five stages of the library's training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.common import documents
from threadloom.llm.decontamination import decontaminated
from threadloom.llm.ngram_jaccard import jaccard_stage
from threadloom.llm.quality_rules import quality_stage
from threadloom.llm.secret_scan import secret_stage
from threadloom.llm.source_mixing import mixing_stage
from threadloom.runtime import drop_path, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_stage(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_stage(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; mostly such ones go."""
    return decontaminated(docs, documents(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced."""
    return secret_stage(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the words taken of each."""
    return mixing_stage(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard", deduplicate),
    ("decontamination", decontaminate),
    ("secret_scan", secrets),
    ("source_mixing", mix),
]

#: Similarity links, the automaton's cuts and keyed draws are beyond one SQL statement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents; each result is written and read again, and dropped once the next is written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before is not None:
            drop_path(spark, before)
        before = path
    return docs
