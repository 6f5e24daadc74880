"""Reading directories of files as (name, text) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.runtime import path_exists


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def decoded(name: Column) -> Column:
    """A file name or path as it was written; metadata columns hold it percent-encoded."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def valid_text(value: Column) -> Column:
    """The text with unix line ends, null when it is not valid UTF-8."""
    return F.when(F.is_valid_utf8(value), unix_newlines(value))


def whole_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, file_name, file_size, value), one row per file; invalid files have no value."""
    found = spark.read.options(**options).text(path, wholetext=True)
    return found.select(
        decoded(F.col("_metadata.file_path")).alias("path"),
        decoded(F.col("_metadata.file_name")).alias("file_name"),
        F.col("_metadata.file_size").alias("file_size"),
        valid_text(F.col("value")).alias("value"),
    )


def _doc_tree(spark: SparkSession, root: str, glob: str) -> DataFrame:
    folders = [f"{root.rstrip('/')}/{name}" for name in ("source", "docs")]
    folder = next((f for f in folders if path_exists(spark, f)), None)
    if folder is None:
        raise FileNotFoundError(f"neither source nor docs below {root}")
    return whole_files(spark, folder, recursiveFileLookup=True, pathGlobFilter=glob)


def doc_files(spark: SparkSession, root: str, glob: str = "*.{md,rst}") -> DataFrame:
    """The ``.md`` and ``.rst`` files below ``source`` or, failing that, ``docs``."""
    return _doc_tree(spark, root, glob).where(F.col("value").isNotNull()).select("path", "value")


def doc_errors(spark: SparkSession, root: str, glob: str = "*.{md,rst}") -> DataFrame:
    """(path, error) of the files that ``doc_files`` leaves out."""
    bad = _doc_tree(spark, root, glob).where(F.col("value").isNull())
    return bad.select("path", F.lit("not valid UTF-8").alias("error"))
