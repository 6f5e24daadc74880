"""Retrieved documents as context lines, plain, filtered and mixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import fixed
from threadloom.operators.cells import CellBounds, search_cells_by_type_exact
from threadloom.operators.vectors import (
    MAX_BROADCAST_QUERIES,
    document_type,
    filter_documents,
    search,
    search_by_type,
    search_cells_by_type,
)

# Results up to this many rows are joined back by broadcast.
_BROADCAST_RESULTS = 1_000_000


def _snippet(length: int) -> Column:
    return F.concat(F.left(F.col("document"), F.lit(length)), F.lit("..."))


def _or_unknown(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("Unknown"))


def _by_type(message: Column, docs: Column) -> Column:
    kind = F.col("metadata.type")
    return (
        F.when(kind == fixed.MESSAGE_TYPE, message)
        .when(kind == fixed.DOCS_TYPE, docs)
        .otherwise(F.col("document"))
    )


def default_context_line() -> Column:
    """``[channel] document`` or ``[WPILib Docs: title] first 200 characters...``."""
    return _by_type(
        F.concat(F.lit("["), _or_unknown("metadata.channel_name"), F.lit("] "), F.col("document")),
        F.concat(F.lit("[WPILib Docs: "), _or_unknown("metadata.title"), F.lit("] "),
                 _snippet(fixed.DEFAULT_SNIPPET)),
    )


def filtered_context_line() -> Column:
    """``[channel] document`` or ``[WPILib] title: first 150 characters...``."""
    none = F.lit("None")
    return _by_type(
        F.concat(F.lit("["), F.coalesce("metadata.channel_name", none), F.lit("] "),
                 F.col("document")),
        F.concat(F.lit("[WPILib] "), F.coalesce("metadata.title", none), F.lit(": "),
                 _snippet(fixed.FILTERED_SNIPPET)),
    )


def wants_docs(query_text: Column, keywords: list[str] | None = None) -> Column:
    """Does the query contain any of the keywords, whatever the case?"""
    lowered = F.lower(query_text)
    words = F.array(*[F.lit(k) for k in keywords or fixed.DOCS_KEYWORDS])
    return F.coalesce(F.exists(words, lambda k: F.contains(lowered, k)), F.lit(False))


def _with_documents(hits: DataFrame, collection: DataFrame, small: bool) -> DataFrame:
    """Fetches text and metadata for the hits only, instead of carrying them through the search."""
    found = F.broadcast(hits) if small else hits
    return collection.select("id", "document", "metadata").join(found, "id")


def _lists(lines: DataFrame, order: list[str]) -> DataFrame:
    """One row per query with its few context lines in order."""
    entry = F.struct(*[F.col(c) for c in order], F.col("context"))
    return lines.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["context"]).alias("contexts")
    )


def retrieve(collection: DataFrame, queries: DataFrame, n: int = fixed.DEFAULT_HITS,
             doc_type: str | None = None, channel: str | None = None, filtered: bool = False,
             min_similarity: float | None = None,
             max_queries: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """(query_id, rank, id, similarity, context) rows, one search for all queries.

    ``filtered`` selects the line format of the filtered form; type and channel
    restrict the collection before the search.
    """
    part = filter_documents(collection, doc_type, channel)
    hits, few, _ = search(part, queries, n, min_similarity, max_queries)
    small = few and n * max_queries <= _BROADCAST_RESULTS
    text = filtered_context_line() if filtered else default_context_line()
    return _with_documents(hits, part, small).select(
        "query_id", "rank", "id", "similarity", text.alias("context")
    )


def context_lists(rows: DataFrame) -> DataFrame:
    return _lists(rows, ["rank"])


def mixed_context(collection: DataFrame, queries: DataFrame,
                  messages: int = fixed.MESSAGE_HITS, docs: int = fixed.DOCS_HITS,
                  keywords: list[str] | None = None, model=None, probes: int = 8,
                  min_similarity: float | None = None, max_queries: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """(query_id, contexts): nearest messages, then nearest docs for queries that want them.

    ``queries`` has (query_id, text, embedding). Both types are searched in one
    pass. With a cell ``model`` only the closest cells of a collection with a
    ``cell`` column are read, which is how a large one serves live requests; with
    ``CellBounds`` as the model, as many further ones as the exact answer needs.
    """
    message_type, docs_type = F.lit(fixed.MESSAGE_TYPE), F.lit(fixed.DOCS_TYPE)
    typed = queries.select(
        "query_id", "embedding",
        F.when(wants_docs(F.col("text"), keywords), F.array(message_type, docs_type))
        .otherwise(F.array(message_type)).alias("types"),
    )
    limits = {fixed.MESSAGE_TYPE: messages, fixed.DOCS_TYPE: docs}
    kind = document_type(collection).alias("type")
    if model is None:
        searched = collection.select("id", kind, "embedding")
        hits, few, _ = search_by_type(searched, typed, limits, max_queries)
    else:
        searched = collection.select("id", kind, "cell", "embedding")
        in_cells = search_cells_by_type_exact if isinstance(model, CellBounds) else search_cells_by_type
        hits, few, groups = in_cells(searched, typed, model, limits, probes, max_queries)
        if groups is not None:
            # the texts of the cells searched: the scan for them skips the other directories
            place = F.concat(kind, F.lit("/"), F.col("cell").cast("string"))
            collection = collection.where(place.isin(list(groups)))
    if min_similarity is not None:
        hits = hits.where(F.col("similarity") >= min_similarity)
    small = few and (messages + docs) * max_queries <= _BROADCAST_RESULTS
    branch = F.when(F.col("metadata.type") == fixed.MESSAGE_TYPE, 0).otherwise(1)
    lines = _with_documents(hits.drop("type"), collection, small).select(
        "query_id", branch.alias("branch"), "rank", filtered_context_line().alias("context")
    )
    return _lists(lines, ["branch", "rank"])
