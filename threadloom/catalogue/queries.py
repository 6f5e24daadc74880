"""The query catalogue: every operator on the driver's tables, by name."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.catalogue import exports, views
from threadloom.functions import fixed, text, times
from threadloom.operators import messages as msg
from threadloom.operators import cells, pairs, prompts, retrieval, sections, vectors
from threadloom.plans import index, ingest, replies
from threadloom.runtime import scratch_path
from threadloom.sinks import snapshots
from threadloom.sinks import tables as sinks
from threadloom.sources import files, html_export, html_ranges, inbox, message_log, tables
from threadloom.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TARGET = ["assistant"]
YEAR = 2025
BOT_ID = "42"
COMMAND = "!ask"
BOT_NAME = "Botty"


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


# --- messages --------------------------------------------------------------------

@query
def source_counts(spark, sf):
    return msg.source_counts(views.messages(spark, sf))


@query
def year_counts(spark, sf):
    return msg.year_counts(views.messages(spark, sf), YEAR)


@query
def author_count(spark, sf):
    return msg.author_count(views.messages(spark, sf), msg.identifiers("", *TARGET, None))


@query
def corpus_totals(spark, sf):
    return msg.corpus_totals(views.messages(spark, sf))


@query
def channel_summary(spark, sf):
    return msg.channel_summary(views.messages(spark, sf))


# --- pairs and datasets -------------------------------------------------------------

@query
def training_pairs(spark, sf):
    made = pairs.training_pairs(views.messages(spark, sf), TARGET)
    return made.select("conv_key", "message_id", "instruction", "response")


@query
def training_pairs_year(spark, sf):
    made = pairs.training_pairs(views.messages(spark, sf), TARGET, YEAR)
    return made.select("conv_key", "message_id", "instruction", "response")


@query
def training_pairs_stored(spark, sf):
    """The same from a stored table, of which only the year's files are read."""
    path = scratch_path(spark, "messages")
    sinks.write_messages(views.messages(spark, sf).fillna({"source": "discord"}), path)
    made = pairs.training_pairs(tables.read_messages(spark, path), TARGET, YEAR)
    return made.select("conv_key", "message_id", "instruction", "response")


def _examples(spark, sf) -> DataFrame:
    return pairs.chat_examples(pairs.training_pairs(views.messages(spark, sf), TARGET))


@query
def chat_examples(spark, sf):
    turns = F.col("conversations")
    return _examples(spark, sf).select(
        "example_id", turns[0]["role"].alias("first_role"),
        turns[0]["content"].alias("first_content"), turns[1]["role"].alias("second_role"),
        turns[1]["content"].alias("second_content"), F.size(turns).alias("n_turns"),
    )


@query
def chat_render(spark, sf):
    return _examples(spark, sf).select(
        "example_id", pairs.render_chat(F.col("conversations")).alias("text")
    )


@query
def hash_split(spark, sf):
    return pairs.hash_split(_examples(spark, sf)).select("example_id", "split")


@query
def exact_split(spark, sf):
    return pairs.exact_split(_examples(spark, sf)).select("example_id", "split")


@query
def split_counts(spark, sf):
    return pairs.split_counts(pairs.exact_split(_examples(spark, sf)))


@query
def chat_datasets(spark, sf):
    """Written per split, read back as a trainer would, rendered."""
    path = scratch_path(spark, "chat")
    sinks.write_chat_datasets(pairs.hash_split(_examples(spark, sf)), path)
    train = tables.read_chat(spark, f"{path}/split=train").withColumn("split", F.lit("train"))
    val = tables.read_chat(spark, f"{path}/split=val").withColumn("split", F.lit("val"))
    return train.unionByName(val).select(
        "example_id", "split", pairs.render_chat(F.col("conversations")).alias("text")
    )


# --- sources and sinks ------------------------------------------------------------------

_HTML_COLUMNS = [
    "source", "conv_key", "guild_name", "channel_name", "message_id", "author_id",
    "author_name", "content", "ts_raw", "is_bot",
]


def _html_whole(spark, sf, keep_continuations: bool = False) -> DataFrame:
    found = html_export.read_html_exports(spark, exports.write_html(spark, sf), keep_continuations=keep_continuations)
    path = scratch_path(spark, "parsed")
    found.write.parquet(path)
    return html_export.with_channels(spark.read.parquet(path))


@query
def html_export_files(spark, sf):
    return html_export.html_messages(_html_whole(spark, sf)).select(*_HTML_COLUMNS)


@query
def html_continuations(spark, sf):
    """Grouped messages kept, with the author and time of the last header before them."""
    return html_export.html_messages(_html_whole(spark, sf, True)).select(*_HTML_COLUMNS)


@query
def html_export_records(spark, sf):
    """The same from ranges of bytes, a file in several tasks."""
    path, stored = exports.write_html(spark, sf), scratch_path(spark, "parsed")
    found = html_ranges.read_html_ranges(spark, path, range_bytes=1 << 20)
    named = F.element_at(F.split("file_name", "/"), -1)
    found.withColumn("file_name", named).write.parquet(stored)
    parsed = html_export.with_channels(spark.read.parquet(stored))
    return html_export.html_messages(parsed).select(*_HTML_COLUMNS)


@query
def html_export_channels(spark, sf):
    return html_export.html_channels(_html_whole(spark, sf))


def _inbox(spark, sf) -> DataFrame:
    return inbox.inbox_files(spark, exports.write_inbox(spark, sf))


@query
def inbox_messages(spark, sf):
    found = inbox.inbox_messages(_inbox(spark, sf))
    return found.select(
        "source", "conv_key", "conversation_name", "message_id", "author_id", "author_name", "content", "ts_raw", "is_bot", "file_name",
    )


@query
def inbox_conversations(spark, sf):
    stored = _inbox(spark, sf)
    found = msg.conversation_summary(
        inbox.inbox_messages(stored), inbox.inbox_participants(stored)
    )
    names = F.transform("participants", lambda n: F.coalesce(n, F.lit("-")))
    return found.select(
        "conversation_dir", F.array_join(names, "|").alias("participants"), "conversation_name",
        "message_count",
    )


@query
def merged_messages(spark, sf):
    """Both platforms in one table; storing the second one again changes nothing."""
    path = scratch_path(spark, "messages")
    sinks.write_messages(html_export.html_messages(_html_whole(spark, sf)), path)
    second = inbox.inbox_messages(_inbox(spark, sf)).select(*msg.MESSAGE_COLUMNS)
    sinks.write_messages(second, path)
    sinks.write_messages(second, path)
    return tables.read_messages(spark, path).select("source", "conv_key", "author_name", "content")


def _ingested(spark, sf) -> str:
    """Both folders ingested into one place, the second twice."""
    out = scratch_path(spark, "ingested")
    ingest.ingest_html(spark, exports.write_html(spark, sf), out)
    folder = exports.write_inbox(spark, sf)
    for _ in range(2):
        ingest.ingest_inbox(spark, folder, out)
    return out


@query
def ingested_messages(spark, sf):
    stored = tables.read_messages(spark, f"{_ingested(spark, sf)}/messages")
    return stored.select("source", "conv_key", "message_id", "author_name", "content", "ts_raw")


@query
def ingest_errors(spark, sf):
    """The files that both scans leave out, and the totals of those they read."""
    out = _ingested(spark, sf)
    errors = spark.read.schema("file_name string, error string").json([f"{out}/errors", f"{out}/inbox_errors"])
    totals = spark.read.json(f"{out}/totals").select("processed_files", "total_messages")
    more = spark.read.json(f"{out}/inbox_totals").select("processed_conversations", "total_messages")
    return errors.select("file_name", "error").unionByName(totals.select(
        F.lit("html").alias("file_name"), F.concat_ws("/", "processed_files", "total_messages").alias("error"),
    )).unionByName(more.select(
        F.lit("inbox").alias("file_name"), F.concat_ws("/", "processed_conversations", "total_messages").alias("error")))


@query
def union_messages(spark, sf):
    """The same union without storing it."""
    first = html_export.html_messages(_html_whole(spark, sf)).drop("conversation_name")
    second = inbox.inbox_messages(_inbox(spark, sf)).drop("guild_name", "channel_name")
    return msg.merge_messages(first, second).select(
        "source", "guild_name", "conversation_name", "author_name", "content"
    )


@query
def conversation_files(spark, sf):
    path = scratch_path(spark, "conversations")
    sinks.write_by_conversation(
        views.messages(spark, sf).fillna({"source": "discord"}), path
    )
    stored = spark.read.schema(msg.MESSAGE_SCHEMA).json(path)
    return stored.groupBy("source", "conv_key").agg(
        F.count(F.lit(1)).alias("n_messages"), F.sum(F.length("content")).alias("n_chars")
    )


@query
def message_json(spark, sf):
    """Exchange JSON with zoned timestamps, read back and counted by year as written."""
    path = scratch_path(spark, "exchange")
    views.messages(spark, sf).select(
        "source", "message_id", "author_id", "author_name", "content",
        F.concat("ts_raw", F.lit("Z")).alias("timestamp"), "is_bot", "guild_name",
        "channel_name", "conversation_name",
    ).write.json(path)
    stored = tables.read_message_json(spark, path, multi_line=False)
    return stored.select(
        "conv_key", "message_id", "content",
        F.coalesce(times.in_year(F.col("ts"), YEAR), F.lit(False)).alias("in_year"),
    )


@query
def export_times(spark, sf):
    """Event times in each accepted spelling, and one that is none."""
    at = F.col("ts")
    spelled = (
        F.when(F.col("event_type") == "view", F.date_format(at, "EEEE, MMMM d, yyyy h:mm a"))
        .when(F.col("event_type") == "click", F.date_format(at, "EEEE, MMMM dd, yyyy hh:mm:ss a"))
        .when(F.col("event_type") == "signup", F.date_format(at, "M/d/yyyy h:mm a"))
        .when(F.col("event_type") == "purchase", F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.concat(F.lit("soon "), "event_id"))
    )
    # newer exports have a narrow no-break space before AM and PM, others a no-break space
    spelled = F.regexp_replace(spelled, " (?=[AP]M$)", "\u202f")
    spelled = F.when(F.col("event_id") % 3 == 0, F.replace(spelled, F.lit("\u202f"), F.lit("\u00a0"))).otherwise(spelled)
    events = views.table(spark, sf, "events").select("event_id", spelled.alias("spelled"))
    parsed = times.parse_export_time(F.col("spelled"))
    return events.select(
        "event_id", F.coalesce(times.iso_text(parsed), "spelled").alias("ts_raw")
    )


# --- documents and sections -----------------------------------------------------------------

def _flat(documents: DataFrame, *fields: str) -> DataFrame:
    return documents.select("id", "document", *[F.col(f"metadata.{f}").alias(f) for f in fields])


_MESSAGE_FIELDS = [
    "message_id", "author_id", "author_name", "channel_name", "guild_name", "timestamp", "type",
]


@query
def message_documents(spark, sf):
    return _flat(vectors.message_documents(views.messages(spark, sf)), *_MESSAGE_FIELDS)


@query
def message_documents_numbered(spark, sf):
    made = vectors.message_documents(views.messages(spark, sf), positional_ids=True)
    return _flat(made, *_MESSAGE_FIELDS)


@query
def doc_sections(spark, sf):
    return sections.doc_sections(views.markdown(spark, sf)).drop("source_path")


@query
def doc_tree(spark, sf):
    """Sections of files found below a documentation root; file names are the writer's."""
    found = files.doc_files(spark, exports.write_docs(spark, sf), glob="*.txt")
    return sections.doc_sections(found).select(
        F.regexp_extract("source_path", r"guide=(\d+)", 1).cast("bigint").alias("guide"),
        "section_no", "level", F.when(F.col("level") > 0, F.col("title")).alias("title"),
        text.py_strip(F.col("content")).alias("content"),
    )


@query
def section_documents(spark, sf):
    made = sections.section_documents(sections.doc_sections(views.markdown(spark, sf)))
    return _flat(made, "title", "file_path", "type", "source")


@query
def section_documents_numbered(spark, sf):
    found = sections.doc_sections(views.markdown(spark, sf))
    return _flat(sections.section_documents(found, positional_ids=True), "title", "file_path")


# --- vectors -----------------------------------------------------------------------------------

def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("similarity", F.round("similarity", 4))


@query
def search_exact(spark, sf):
    found = vectors.search(views.collection(spark, sf), views.vector_queries(spark, sf), 5)
    return _rounded(found.rows)


@query
def search_tiles(spark, sf):
    """The way taken when the queries are too many to broadcast."""
    found = vectors.search(
        views.collection(spark, sf), views.vector_queries(spark, sf), 5,
        max_queries=300, tile_rows=300,
    )
    return _rounded(found.rows)


@query
def search_filtered(spark, sf):
    part = vectors.filter_documents(views.collection(spark, sf), fixed.MESSAGE_TYPE, "ch3")
    found = vectors.search(part, views.vector_queries(spark, sf), 3, min_similarity=0.05)
    return _rounded(found.rows)


@query
def search_by_type(spark, sf):
    typed = views.collection(spark, sf).select(
        "id", F.col("metadata.type").alias("type"), "embedding"
    )
    asked = views.vector_queries(spark, sf).withColumn(
        "types", F.array(F.lit(fixed.MESSAGE_TYPE), F.lit(fixed.DOCS_TYPE))
    )
    limits = {fixed.MESSAGE_TYPE: fixed.MESSAGE_HITS, fixed.DOCS_TYPE: fixed.DOCS_HITS}
    return _rounded(vectors.search_by_type(typed, asked, limits).rows)


def _certified(spark, sf, **limits) -> DataFrame:
    """Cells around given points, the sixteen vectors with the least numbers."""
    path = scratch_path(spark, "cells")
    first = views.vector_queries(spark, sf).orderBy("query_id").limit(16).collect()
    centres = vectors.Centres([r["embedding"] for r in first])
    model = index.build_cells(views.collection(spark, sf), path, 16, centres=centres)
    celled = spark.read.parquet(path)
    bounds = cells.cell_bounds(celled, model)
    found = cells.search_cells_exact(celled, views.vector_queries(spark, sf), bounds, 5, **limits)
    return _rounded(found.rows)


@query
def search_cells(spark, sf):
    """The exact answer from the nearest cells and those that may hold nearer ones."""
    return _certified(spark, sf)


@query
def search_all_cells(spark, sf):
    """With every cell probed the answer is the exact one."""
    path = scratch_path(spark, "cells")
    model = index.build_cells(views.collection(spark, sf), path, 16)
    asked = views.vector_queries(spark, sf)
    return _rounded(vectors.search_cells(spark.read.parquet(path), asked, model, 5, 16).rows)


@query
def embed_hashed(spark, sf):
    docs = views.table(spark, sf, "documents")
    counted = vectors.hashed_term_counts(docs, "text", "counts")
    made = vectors.embed_hashed(counted, "text")
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    words = F.aggregate(vectors.vector_to_array("counts"), F.lit(0.0), lambda a, x: a + x)
    return made.select(
        "doc_id", F.size("embedding").alias("dimensions"),
        F.round(squares, 4).alias("squares"), words.cast("bigint").alias("n_words"),
    )


def _letters():
    """A stand-in for a user's model: counts of the letters a to z, in either case."""
    def encode(texts: list[str]) -> np.ndarray:
        letters = "abcdefghijklmnopqrstuvwxyz"
        return np.array([[t.count(c) + t.count(c.upper()) for c in letters] for t in texts])

    return encode


@query
def embed_model(spark, sf):
    """Documents through a given model, all numbers of each vector."""
    made = vectors.embed_with(_letters, F.col("text"))
    whole = F.transform(made, lambda x: x.cast("int").cast("string"))
    return views.table(spark, sf, "documents").select("doc_id", F.array_join(whole, ",").alias("vector"))


@query
def search_embedded(spark, sf):
    """Benchmark texts searched among the documents, both embedded by one model."""
    def embedded(name: str, key: str, as_key: str) -> DataFrame:
        made = vectors.embed_with(_letters, F.col("text"))
        return views.table(spark, sf, name).select(F.col(key).alias(as_key), made.alias("embedding"))

    found = vectors.search(
        embedded("documents", "doc_id", "id"), embedded("benchmark", "item_id", "query_id"), 3
    )
    return _rounded(found.rows)


@query
def search_weighted(spark, sf):
    """Benchmark texts searched among the documents by words, those of few documents counting more."""
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = views.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    weights = vectors.fit_word_weights(docs, "text")
    made, wanted = (vectors.embed_hashed(df, "text", weights=weights).drop("text") for df in (docs, asked))
    return _rounded(vectors.search(made, wanted, 3).rows)


@query
def search_cell_tiles(spark, sf):
    """``search_cells`` where the queries of a cell are too many to broadcast."""
    return _certified(spark, sf, max_queries=50, tile_rows=50)


@query
def rebuilt_collection(spark, sf):
    """Message documents embedded and stored; a second build, its vectors from the ledger, replaces the first."""
    path, ledger = scratch_path(spark, "collection"), index.Ledger(scratch_path(spark, "ledger"), "hashed-256")
    for _ in range(2):
        built = index.build_collection(views.messages(spark, sf), path, ledger=ledger)
    return index.collection_size(built)


@query
def incremental_add(spark, sf):
    """Part of the vectors stored first, then all of them added, twice."""
    path = scratch_path(spark, "collection")
    every = views.collection(spark, sf)
    typed = every.withColumn("type", F.col("metadata.type"))
    snapshots.replace_snapshot(typed.where(F.col("label") < 3), path, ["type"])
    for _ in range(2):
        snapshots.add_to_snapshot(typed, path, "id", ["type"])
    return snapshots.read_snapshot(spark, path).select("id", "type", "document")


# --- retrieval -------------------------------------------------------------------------------------

@query
def retrieve_default(spark, sf):
    found = retrieval.retrieve(views.collection(spark, sf), views.questions(spark, sf))
    return found.select("query_id", "rank", "id", "context")


@query
def retrieve_filtered(spark, sf):
    found = retrieval.retrieve(
        views.collection(spark, sf), views.questions(spark, sf), 4,
        doc_type=fixed.MESSAGE_TYPE, channel="ch2", filtered=True,
    )
    return found.select("query_id", "rank", "id", "context")


@query
def mixed_context(spark, sf):
    found = retrieval.mixed_context(views.collection(spark, sf), views.questions(spark, sf))
    return found.select("query_id", F.array_join("contexts", "\n---\n").alias("contexts"))


@query
def mixed_context_cells(spark, sf):
    """The same from a collection stored by type and cell, by certified searches."""
    path = scratch_path(spark, "celled")
    model = index.build_cells(views.collection(spark, sf), path, 8)
    celled = spark.read.parquet(path)
    found = retrieval.mixed_context(
        celled, views.questions(spark, sf), model=cells.cell_bounds(celled, model), probes=2
    )
    return found.select("query_id", F.array_join("contexts", "\n---\n").alias("contexts"))


# --- history, memory and prompts --------------------------------------------------------------------

@query
def channel_history(spark, sf):
    seen = prompts.with_history(views.channels(spark, sf), ["channel"], ["ts", "event_id"])
    return seen.where(F.col("author_name") == "purchase").select(
        "event_id", "channel", F.array_join("history", "\n").alias("history")
    )


@query
def rolling_memory(spark, sf):
    turns = views.messages(spark, sf)
    is_user = F.col("author_name") == "user"
    kept = prompts.with_memory(turns, ["conv_key"], msg.TIME_ORDER, is_user, F.col("content"))
    return kept.where(is_user).select(
        "message_id", F.array_join("memory", "\n").alias("memory")
    )


def _requests(spark, sf) -> tuple[DataFrame, DataFrame]:
    """User turns as requests with history, and their questions with a vector each."""
    seen = prompts.with_history(views.messages(spark, sf), ["conv_key"], msg.TIME_ORDER)
    requests = seen.where(F.col("author_name") == "user").select(
        F.col("message_id").alias("request_id"),
        F.replace("content", F.lit("oua"), F.lit("robot")).alias("user_text"), "history",
    )
    return requests, _embedded(
        spark, sf, requests.select(F.col("request_id").alias("query_id"),
                                   F.col("user_text").alias("text")),
    )


def _embedded(spark, sf, asked: DataFrame) -> DataFrame:
    """Questions with the vector numbered like their conversation."""
    known = views.table(spark, sf, "embeddings").select("vec_id", "embedding")
    number = F.regexp_extract("query_id", r"m(\d+)-", 1).cast("bigint")
    return asked.withColumn("vec_id", number).join(known, "vec_id").drop("vec_id")


@query
def prompt_assembly(spark, sf):
    requests, embedded = _requests(spark, sf)
    made = replies.prompts(requests, views.collection(spark, sf), embedded, BOT_NAME)
    return made.select("request_id", "prompt")


@query
def prompt_tester(spark, sf):
    """The local tester's system text, with memory and without retrieval."""
    turns = views.messages(spark, sf)
    is_user = F.col("author_name") == "user"
    kept = prompts.with_memory(turns, ["conv_key"], msg.TIME_ORDER, is_user, F.col("content"))
    none = F.lit(None).cast("array<string>")
    return kept.where(is_user).select(
        "message_id",
        prompts.prompt(F.col("content"), F.col("memory"), none, fixed.TESTER_SYSTEM_TEXT)
        .alias("prompt"),
    )


# --- replies -----------------------------------------------------------------------------------------

def _by_turn(*texts: Column) -> Column:
    """The first text for the first turn and so on, the last for all later turns."""
    *given, rest = texts
    chosen = F
    for turn, item in enumerate(given):
        chosen = chosen.when(F.col("turn") == turn, item)
    return chosen.otherwise(rest)


def _raw_replies(spark, sf) -> DataFrame:
    said = F.col("text")
    raw = _by_turn(
        F.concat(said, F.lit(fixed.IM_END), said),
        F.concat(F.lit("\n"), said, F.lit(fixed.IM_START + "user")),
        F.concat(F.lit(" You Are Botty "), said),
        F.concat(F.lit("donât itâs "), said, F.lit("â\u0080\u0099")),
        F.concat(said, F.lit(fixed.EOF_MARK), said),
        F.replace(said, F.lit("e"), F.lit("â\u0080\u009c")),
    )
    return views.table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw"))


@query
def reply_cleanup(spark, sf):
    return _raw_replies(spark, sf).select(
        "conv_id", "turn", text.clean_reply(F.col("raw"), BOT_NAME).alias("reply")
    )


@query
def reply_steps(spark, sf):
    raw = F.col("raw")
    return _raw_replies(spark, sf).select(
        "conv_id", "turn", text.cut_at_markers(raw).alias("cut"),
        text.is_prompt_echo(text.py_strip(raw), BOT_NAME).alias("echo"),
        text.fix_mojibake(raw).alias("repaired"),
    )


@query
def reply_cap(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", text.cap_reply(F.col("text")).alias("reply")
    )


@query
def assistant_turn(spark, sf):
    said, prompt = F.col("text"), F.concat(F.lit("P "), F.col("role"))
    marked = F.concat(
        prompt, F.lit(fixed.ASSISTANT_MARK + " x" + fixed.ASSISTANT_MARK + "\n"), said,
        F.lit(fixed.IM_END),
    )
    bare = F.concat(prompt, said, F.lit(fixed.IM_END))
    return views.table(spark, sf, "conversations").select(
        "conv_id", "turn",
        text.assistant_turn(_by_turn(marked, bare, marked, bare), prompt).alias("reply"),
    )


@query
def image_commands(spark, sf):
    said = F.col("text")
    raw = _by_turn(
        F.concat(said, F.lit("\n@meta  AI /Imagine "), said),
        F.concat(F.lit("/imagine "), said), said, F.concat(F.lit("x /IMAGINE"), said),
        F.concat(F.lit("a /imagine  @Meta AI /imagine b "), said), said,
    )
    found = views.table(spark, sf, "conversations").select(
        "conv_id", "turn", text.image_prompt(raw).alias("image_prompt")
    )
    cleaned = text.clean_image_prompt(F.col("image_prompt"))
    return found.select(
        "*", cleaned.alias("prompt"), text.image_file_name(cleaned).alias("file_name")
    )


@query
def triggers(spark, sf):
    return replies.triggers(_live(spark, sf), BOT_ID, COMMAND).select(
        "message_id", "trigger", "user_text"
    )


# --- streams -------------------------------------------------------------------------------------------

def _live(spark, sf) -> DataFrame:
    """Conversation turns as live messages with mentions and commands; systems are the bot."""
    said = F.col("text")
    content = _by_turn(
        F.lit("<@42>"), F.concat(F.lit("hi <@!42> "), said), F.concat(F.lit("!ask "), said),
        F.lit("!ask"), F.concat(F.lit("!asking "), said), F.lit("!ask <@42> now"), said,
    )
    author = F.when(F.col("role") == "system", BOT_ID).otherwise(F.col("role"))
    return views.table(spark, sf, "conversations").select(
        F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn").alias("message_id"),
        F.concat(F.lit("c"), "conv_id").alias("channel"), views.stamp().alias("ts"), "turn",
        author.alias("author_id"), author.alias("author_name"), content.alias("content"),
        (F.col("role") == "system").alias("is_bot"),
    )


def _arrivals(spark, rows: DataFrame, order: Column, cuts: list, writer) -> None:
    """The rows arrive in parts; the stream of ``writer`` is taken up after each, for one batch."""
    path = scratch_path(spark, "feed")
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows
        if low is not None:
            part = part.where(order >= low)
        if high is not None:
            part = part.where(order < high)
        part.write.mode("append").parquet(path)
        feed = spark.readStream.schema(rows.schema).parquet(path)
        writer(feed).trigger(availableNow=True).start().awaitTermination()


@query
def stream_history(spark, sf):
    """Channel history from live batches; equal to the batch result."""
    cuts = [F.lit(f"2024-01-{day:02d}").cast("timestamp_ntz") for day in (8, 15, 22)]
    base = scratch_path(spark, "history")
    _arrivals(spark, views.channels(spark, sf), F.col("ts"), cuts, lambda feed: live.history_stream(
        feed, F.col("author_name") == "purchase", f"{base}/out", f"{base}/checkpoint", ["channel"], ["ts", "event_id"],
    ))
    return spark.read.parquet(f"{base}/out").select(
        "event_id", "channel", F.array_join("history", "\n").alias("history")
    )


@query
def stream_log(spark, sf):
    """Messages of a live client's logs, which get more between two runs of the stream."""
    logs, out = scratch_path(spark, "logs"), scratch_path(spark, "logged")
    for turns in (F.col("turn") < 2, F.col("turn") >= 2):
        exports.write_logs(spark, sf, logs, turns)
        found = message_log.stream_message_log(spark, logs, "part-*", 1 << 20)
        found.writeStream.format("parquet").option("path", f"{out}/rows").option(
            "checkpointLocation", f"{out}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(
        "source", "conv_key", "message_id", "author_name", "content", "ts_raw", "is_bot")


@query
def stream_replies(spark, sf):
    """Live messages to replies and image jobs, with a stand-in for the model."""
    rows = _live(spark, sf)

    def generate(prompted: DataFrame) -> DataFrame:
        drawn = F.when(F.col("trigger") == "command", "/imagine ").otherwise("")
        size = F.length("prompt").cast("string")
        return prompted.withColumn("raw_reply", F.concat(
            drawn, "user_text", F.lit(" / "), size, F.lit(fixed.IM_END + "more")
        ))

    def contexts(asked: DataFrame) -> DataFrame:
        return retrieval.mixed_context(
            views.collection(spark, sf), _embedded(spark, sf, asked)
        )

    base = scratch_path(spark, "replies")
    _arrivals(spark, rows, F.col("turn"), [F.lit(2), F.lit(4)], lambda feed: live.reply_stream(
        feed, contexts, generate, BOT_ID, COMMAND, BOT_NAME, base, f"{base}/checkpoint",
        ["channel"], ["ts", "turn"], max_chars=300,
    ))
    sent = live.sent(spark, base, "replies").select("request_id", "reply")
    jobs = live.sent(spark, base, "image_jobs").select("request_id", "prompt", "file_name")
    return sent.join(jobs, "request_id", "left")
