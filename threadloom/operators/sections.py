"""Documentation files cut into sections at their headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import fixed
from threadloom.functions.metadata import metadata
from threadloom.functions.text import py_strip
from threadloom.operators.ordered import global_index

# --- fixed values: a heading is 1-6 hashes, white space, text, up to a line feed ---
_GAP = r"[\s\x1c-\x1f&&[^\n]]+"
_HEADING_LINE = rf"(?dU)\A(#{{1,6}}){_GAP}(.+)"
_HEADING_AHEAD = rf"(?mdU)^(?=#{{1,6}}{_GAP}.)"


def relative_path(path: Column) -> Column:
    """The last three parts of a path: file, directory and the directory above."""
    return F.concat_ws("/", F.slice(F.split(path, "/"), F.lit(-3), F.lit(3)))


def _last_three(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 3, relative_path(path)).otherwise(path)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*\z", "")


def doc_sections(files: DataFrame) -> DataFrame:
    """(path, value) files to (source_path, path, section_no, level, title, content) rows.

    Each text is split ahead of its heading lines and exploded in place, so no
    shuffle is needed. Text before the first heading is section 0, titled after
    the file. Sections without body text are dropped, their number is not reused.
    """
    # The line feed in front makes the first piece what precedes any heading; the
    # one behind ends the last line as all the others end.
    framed = F.concat(F.lit("\n"), F.col("value"), F.lit("\n"))
    pieces = files.select(
        "path", F.posexplode(F.split(framed, _HEADING_AHEAD, -1)).alias("section_no", "_text")
    ).withColumn(
        "_line",
        F.when(F.col("section_no") > 0, F.substring_index("_text", "\n", 1)).otherwise(""),
    ).withColumn("content", F.substr(F.col("_text"), F.length("_line") + 2))
    return pieces.where(F.length(py_strip(F.col("content"))) > 0).select(
        F.col("path").alias("source_path"),
        _last_three(F.col("path")).alias("path"),
        "section_no",
        F.length(F.regexp_extract("_line", _HEADING_LINE, 1)).alias("level"),
        F.when(F.col("section_no") > 0, py_strip(F.regexp_extract("_line", _HEADING_LINE, 2)))
        .otherwise(file_stem(F.col("path"))).alias("title"),
        "content",
    )


def section_documents(
    sections: DataFrame, min_chars: int = fixed.MIN_SECTION_CHARS, positional_ids: bool = False
) -> DataFrame:
    """Sections as (id, document, metadata), without those under ``min_chars``.

    Ids are hashes of path and section number; ``positional_ids`` numbers the
    kept sections in (path, section) order instead, which costs a sort.
    """
    document = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), py_strip(F.col("content")))
    kept = sections.select("source_path", "path", "section_no", "title", document.alias("document")).where(
        F.length("document") >= min_chars
    )
    if positional_ids:
        numbered = global_index(kept, ["source_path", "section_no"], "_n")
        doc_id = F.concat(F.lit("wpilib_doc_"), F.col("_n"))
    else:
        numbered = kept
        doc_id = F.sha2(F.concat_ws("|", F.lit("doc"), "source_path", "section_no"), 256)
    described = metadata(
        type=F.lit(fixed.DOCS_TYPE), title=F.col("title"), file_path=F.col("path"),
        source=F.lit(fixed.DOCS_SOURCE),
    )
    return numbered.select(doc_id.alias("id"), "document", described.alias("metadata"))
