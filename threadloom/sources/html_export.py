"""Messages from HTML channel exports.

``read_html_exports`` parses every file whole, whatever its size. ``html_ranges`` reads exports
too large for one task in ranges of bytes.

A file that cannot be parsed, and a message that cannot, becomes an error row; the others
are not affected. The raw rows of either way are meant to be stored once; ``with_channels``,
``html_messages``, ``html_channels`` and ``html_errors`` then read them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.times import iso_text, parse_export_time, parse_iso
from threadloom.operators.messages import MESSAGE_COLUMNS, conversation_key
from threadloom.sources.files import whole_files

# --- fixed values: the export's markup ---
_CONTAINER = "chatlog__message-container"
_ID_ATTRIBUTE = "data-message-id"
_AUTHOR, _AUTHOR_TAG, _USER_ID = "chatlog__author", "chatlog__author-tag", "data-user-id"
_MESSAGE, _PRIMARY, _HEADER = "chatlog__message", "chatlog__message-primary", "chatlog__header"
_TIMESTAMP, _CONTENT, _MARKED = "chatlog__timestamp", "chatlog__content", "chatlog__markdown-preserve"
_PREAMBLE = "preamble__entry"
_FILE_NAME = r"^(.+?) - .+? - (.+?) \[(\d+)\]"
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)

_PARSED = pa.schema([
    ("file_name", pa.string()), ("ordinal", pa.int64()), ("guild", pa.string()),
    ("channel_path", pa.string()), ("message_id", pa.string()), ("author_id", pa.string()),
    ("author_text", pa.string()), ("author_title", pa.string()), ("time_title", pa.string()),
    ("content", pa.string()), ("is_bot", pa.bool_()), ("error", pa.string()),
])
_PARSED_SQL = """
    file_name string, ordinal bigint, guild string, channel_path string, message_id string,
    author_id string, author_text string, author_title string, time_title string,
    content string, is_bot boolean, error string
"""


class _Element:
    """A tag with its children; enough of a tree to look up classes and text."""

    __slots__ = ("tag", "attributes", "classes", "children")

    def __init__(self, tag: str, attributes: dict):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.classes = attributes.get("class", "").split()

    def all(self, tag: str, name: str) -> Iterator[_Element]:
        waiting = [iter(self.children)]
        while waiting:
            child = next(waiting[-1], None)
            if child is None:
                waiting.pop()
            elif isinstance(child, _Element):
                if child.tag == tag and name in child.classes:
                    yield child
                if child.children:
                    waiting.append(iter(child.children))

    def first(self, tag: str, name: str) -> _Element | None:
        return next(self.all(tag, name), None)

    def texts(self) -> Iterator[str]:
        waiting = [iter(self.children)]
        while waiting:
            child = next(waiting[-1], None)
            if child is None:
                waiting.pop()
            elif isinstance(child, str):
                yield child
            else:
                waiting.append(iter(child.children))


# The start of a comment, a declaration, or a tag; the loose form ignores quotes.
_TOKEN = re.compile(
    r"<!--|<[!?][^>]*>|<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.IGNORECASE
)
_LOOSE = re.compile(r"<(/?)([a-z][^\s/>]*+)([^>]*)>", re.IGNORECASE)
# What ends an element whose text is never shown.
_UNSEEN = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "template")}
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _attributes(text: str) -> dict:
    return {
        name.lower(): unescape(double or single or bare)
        for name, double, single, bare in _ATTRIBUTE.findall(text)
    }


def _add_text(open_tags: list[_Element], opened: Counter, pieces: list[str]) -> None:
    text = "".join(pieces)
    pieces.clear()
    if not text.strip(" \n\t\f\r") and not (opened["pre"] or opened["textarea"]):
        text = "\n" if "\n" in text else " "
    open_tags[-1].children.append(unescape(text) if "&" in text else text)


def _tree(html: str) -> _Element:
    """Tolerant tree building: void tags never open, stray end tags do nothing."""
    open_tags, pieces, at = [_Element("", {})], [], 0
    opened: Counter = Counter()
    while (start := html.find("<", at)) >= 0:
        token = _TOKEN.match(html, start)
        if not token and html.find(">", start) < 0:
            break
        # A tag with an unpaired quote ends at the next angle bracket; the rest is text.
        token = token or _LOOSE.match(html, start)
        if not token:
            pieces.append(html[at:start + 1])
            at = start + 1
            continue
        if start > at:
            pieces.append(html[at:start])
        at = token.end()
        if pieces:
            _add_text(open_tags, opened, pieces)
        closing, tag, rest = token.groups()
        if not tag:
            if token.group() == "<!--":
                end = html.find("-->", at)
                at = end + 3 if end >= 0 else len(html)
            continue
        tag = tag.lower()
        if tag in _UNSEEN and not closing:
            end = _UNSEEN[tag].search(html, at)
            at = end.end() if end else len(html)
        elif not closing:
            # Only the attributes of these two are ever looked at.
            element = _Element(tag, _attributes(rest) if tag in ("div", "span") else {})
            open_tags[-1].children.append(element)
            if tag not in _VOID and not rest.endswith("/"):
                open_tags.append(element)
                opened[tag] += 1
        elif opened[tag]:
            ended = None
            while ended != tag:
                ended = open_tags.pop().tag
                opened[ended] -= 1
    if at < len(html) or pieces:
        _add_text(open_tags, opened, [*pieces, html[at:]])
    return open_tags[0]


def _plain(element: _Element) -> str:
    return "".join(t.strip() for t in element.texts())


def _channel(tree: _Element) -> dict:
    entries = [_plain(e) for e in tree.all("div", _PREAMBLE)]
    return dict(zip(("guild", "channel_path"), entries)) if len(entries) > 1 else {}


def _message(container: _Element, before: dict | None = None) -> dict | None:
    """The fields of one container; null without message, primary part or header.

    With ``before``, the header's fields of the last message that had one, a container
    without a header continues that message's author and time.
    """
    inner = container.first("div", _MESSAGE)
    primary = inner and inner.first("div", _PRIMARY)
    header = primary and primary.first("div", _HEADER)
    if not header and not (primary and before):
        return None
    box = primary.first("div", _CONTENT)
    marked = box and box.first("span", _MARKED)
    if not header:
        return before | {
            "message_id": container.attributes.get(_ID_ATTRIBUTE),
            "content": "\n".join((marked or box).texts()).strip() if box else "",
        }
    author = header.first("span", _AUTHOR)
    time = header.first("span", _TIMESTAMP)
    fields = {
        "message_id": container.attributes.get(_ID_ATTRIBUTE),
        "content": "\n".join((marked or box).texts()).strip() if box else "",
        "is_bot": primary.first("span", _AUTHOR_TAG) is not None,
        "time_title": time.attributes.get("title") if time else None,
    }
    if author:
        fields |= {
            "author_text": _plain(author), "author_id": author.attributes.get(_USER_ID),
            "author_title": author.attributes.get("title"),
        }
    return fields


_NOT_TEXT = "not valid UTF-8"


_HEADER_FIELDS = ("author_text", "author_id", "author_title", "time_title", "is_bot")


def _file_rows(name: dict, text: str, keep_continuations: bool) -> Iterator[dict]:
    """A row without ordinal for the file, then its messages, or why one of them failed."""
    tree = _tree(text)
    channel = name | _channel(tree)
    yield channel
    before: dict | None = None
    for i, container in enumerate(tree.all("div", _CONTAINER)):
        try:
            found = _message(container, before)
        except Exception as failure:
            yield channel | {"ordinal": i, "error": f"message {i}: {failure!r}"}
            continue
        if found:
            yield channel | found | {"ordinal": i}
            if keep_continuations:
                before = {k: found.get(k) for k in _HEADER_FIELDS}


def _files_parser(keep_continuations: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                name = {"file_name": file["file_name"]}
                if file["value"] is None:
                    rows = [name | {"error": _NOT_TEXT}]
                else:
                    try:
                        rows = list(_file_rows(name, file["value"], keep_continuations))
                    except Exception as failure:
                        rows = [name | {"error": repr(failure)}]
                yield pa.RecordBatch.from_pylist(rows, schema=_PARSED)

    return parse


def parse_html_files(files: DataFrame, keep_continuations: bool = False) -> DataFrame:
    """(file_name, value) whole files to raw rows; ``ordinal`` is null on the file's own row.

    ``keep_continuations`` gives grouped messages, which have no header of their own,
    the author and time of the last message with one.
    """
    parse = _files_parser(keep_continuations)
    return files.select("file_name", "value").mapInArrow(parse, _PARSED_SQL)


def with_channels(parsed: DataFrame) -> DataFrame:
    """Gives the messages of split files their channel and leaves out files with errors.

    ``parsed`` is read three times, so it should be a stored table. The joins are
    by file with one row per file on the other side: broadcast when that is
    small, else an adaptive skew join splits a file that holds most of the rows.
    """
    own = parsed.where(F.col("ordinal").isNull() & F.col("channel_path").isNotNull()).select(
        "file_name", F.col("guild").alias("_guild"), F.col("channel_path").alias("_path")
    )
    failed = parsed.where(F.col("error").isNotNull() & F.col("ordinal").isNull())
    failed = failed.select("file_name").distinct()
    sound = parsed.join(failed, "file_name", "left_anti")
    return sound.join(own, "file_name", "left").withColumns({
        "guild": F.coalesce("guild", "_guild"),
        "channel_path": F.coalesce("channel_path", "_path"),
    }).select(*parsed.columns)


def html_errors(parsed: DataFrame) -> DataFrame:
    """The files, and the messages of files, that could not be read, with the reason."""
    return parsed.where(F.col("error").isNotNull()).select("file_name", "error").distinct()


def _channel_columns() -> tuple[Column, Column]:
    """Guild and channel: from the preamble, else from the file name, else unknown."""
    stem = F.regexp_replace("file_name", r"(?<=.)\.[^.]*\z", "")
    guild, channel = (
        F.nullif(F.regexp_extract(stem, _FILE_NAME, group), F.lit("")) for group in (1, 2)
    )
    named = F.col("channel_path").isNotNull()
    return (
        F.when(named, F.col("guild")).otherwise(F.coalesce(guild, F.lit("Unknown Guild"))),
        F.when(named, F.element_at(F.split("channel_path", " / ", -1), -1))
        .otherwise(F.coalesce(channel, F.lit("Unknown Channel"))),
    )


def html_messages(parsed: DataFrame) -> DataFrame:
    """Raw rows to the message table; blank messages are left out."""
    guild, channel = _channel_columns()
    author = F.coalesce(F.nullif("author_title", F.lit("")), "author_text", F.lit("Unknown"))
    stated = F.nullif(F.col("time_title"), F.lit(""))
    named = (
        parsed.where(F.col("ordinal").isNotNull() & (F.length("content") > 0))
        .withColumns({"guild_name": guild, "channel_name": channel, "author_name": author})
        .withColumns({
            "source": F.lit("discord"), "conversation_name": F.lit(None).cast("string"),
            "ts": F.coalesce(parse_export_time(stated), parse_iso(stated)),
            "conv_key": conversation_key(),
            "ts_raw": F.coalesce(iso_text(parse_export_time(stated)), stated),
        })
    )
    return named.select(*MESSAGE_COLUMNS)


def html_channels(parsed: DataFrame) -> DataFrame:
    """Per file: guild, channel and message count, also for files without messages."""
    guild, channel = _channel_columns()
    return (
        parsed.where(F.col("error").isNull())
        .withColumns({"guild_name": guild, "channel_name": channel})
        .groupBy("file_name", "guild_name", "channel_name")
        .agg(F.count_if(F.col("ordinal").isNotNull() & (F.length("content") > 0))
             .alias("message_count"))
    )


def read_html_exports(spark: SparkSession, path: str, glob: str = "*.html",
                      keep_continuations: bool = False) -> DataFrame:
    """Raw rows of every matching file directly below ``path``, each parsed whole."""
    return parse_html_files(whole_files(spark, path, pathGlobFilter=glob), keep_continuations)
