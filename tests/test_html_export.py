"""HTML exports: markup cases, whole files against split records."""

import time

import pytest
from pyspark.sql import functions as F

from threadloom.operators.messages import MESSAGE_COLUMNS
from threadloom.sources import files, html_export
import pyarrow as pa

from threadloom.sources import html_export
from threadloom.sources.html_export import (
    html_channels,
    html_errors,
    html_messages,
    parse_html_files,
    read_html_exports,
    with_channels,
)

STAMP = "Thursday, October 13, 2022 5:07 PM"


def message(number, body="", author="Ann", title=None, user="7", time=STAMP, bot=False,
            header=True, span=True, content=True):
    parts = [f'<div class="chatlog__message-container" data-message-id="{number}">'
             '<div class="chatlog__message"><div class="chatlog__message-primary">']
    if header:
        parts.append('<div class="chatlog__header">')
        if author is not None:
            attribute = f' title="{title}"' if title is not None else ""
            parts.append(f'<span class="chatlog__author" data-user-id="{user}"{attribute}> {author} </span>')
        if bot:
            parts.append('<span class="chatlog__author-tag">BOT</span>')
        if time is not None:
            parts.append(f'<span class="chatlog__timestamp" title="{time}">x</span>')
        parts.append("</div>")
    if content:
        inner = f'<span class="chatlog__markdown-preserve">{body}</span>' if span else body
        parts.append(f'<div class="chatlog__content chatlog__markdown">{inner}</div>')
    return "".join(parts) + "</div></div></div>\n"


def export(*messages, entries=("Guild", "Talk / fun / general")):
    head = "".join(f'<div class="preamble__entry">{e}</div>' for e in entries)
    return f"<!DOCTYPE html><html><head><style>.chatlog__message-container{{}}</style></head><body>{head}<div class=\"chatlog\">{''.join(messages)}</div></body></html>"


def parsed(spark, text, name="file.html"):
    rows = spark.createDataFrame([(name, text)], "file_name string, value string")
    return parse_html_files(rows)


def messages_of(spark, text, name="file.html"):
    found = html_messages(parsed(spark, text, name)).orderBy("ordinal").collect()
    return [r.asDict() for r in found]


def test_fields(spark):
    row, = messages_of(spark, export(message(1, "hi <em>all</em>&amp; you", title="ann.real")))
    assert row["message_id"] == "1" and row["author_id"] == "7"
    assert row["author_name"] == "ann.real"
    assert row["content"] == "hi \nall\n& you"
    assert row["ts_raw"] == "2022-10-13T17:07:00" and not row["is_bot"]
    assert (row["guild_name"], row["channel_name"]) == ("Guild", "general")
    assert row["conv_key"] == "discord_Guild_general" and row["source"] == "discord"
    assert row["conversation_name"] is None and list(row) == MESSAGE_COLUMNS


def test_author_cases(spark):
    rows = messages_of(spark, export(
        message(1, "a"), message(2, "b", title=""), message(3, "c", author=None),
        message(4, "d", bot=True),
    ))
    assert [r["author_name"] for r in rows] == ["Ann", "Ann", "Unknown", "Ann"]
    assert [r["author_id"] for r in rows] == ["7", "7", None, "7"]
    assert [r["is_bot"] for r in rows] == [False, False, False, True]


def test_dropped_messages(spark):
    """Continuations, blank texts, missing content and missing inner elements."""
    hollow = '<div class="chatlog__message-container" data-message-id="9"><p>x</p></div>'
    rows = messages_of(spark, export(
        message(1, "a", header=False), message(2, " \n "), message(3, content=False), hollow,
        message(4, "kept"),
    ))
    assert [(r["message_id"], r["ordinal"]) for r in rows] == [("4", 4)]


def test_content_without_preserve_span(spark):
    row, = messages_of(spark, export(message(1, "one<br>two<!-- note -->three", span=False)))
    assert row["content"] == "one\ntwo\nthree"


def test_times(spark):
    times = [STAMP, "Friday, October 14, 2022 5:07:09 AM", "10/13/2022 5:07 PM",
             "2022-10-13 17:07:01", "last week", "", None]
    rows = messages_of(spark, export(*[message(i, "a", time=t) for i, t in enumerate(times)]))
    assert [r["ts_raw"] for r in rows] == [
        "2022-10-13T17:07:00", "2022-10-14T05:07:09", "2022-10-13T17:07:00",
        "2022-10-13T17:07:01", "last week", None, None,
    ]
    assert [r["ts"] is None for r in rows] == [False] * 4 + [True] * 3


@pytest.mark.parametrize("entries,name,place", [
    (("G", "only"), "x.html", ("G", "only")),
    (("G", "a / b"), "x.html", ("G", "b")),
    (("G", "a/b"), "x.html", ("G", "a/b")),
    (("G",), "My - Cat - chan [12].html", ("My", "chan")),
    ((), "My Guild - A - B - chan [12].html", ("My Guild", "B - chan")),
    ((), "plain.html", ("Unknown Guild", "Unknown Channel")),
])
def test_channel(spark, entries, name, place):
    row, = messages_of(spark, export(message(1, "a"), entries=entries), name)
    assert (row["guild_name"], row["channel_name"]) == place


def test_unclosed_tags(spark):
    broken = message(1, "<b>bold <i>both").replace("</span></div></div>", "</div></div>", 1)
    rows = messages_of(spark, export(broken + message(2, "next</p></section>")))
    assert rows[-1]["message_id"] == "2" and rows[-1]["content"] == "next"
    assert rows[0]["content"] == "bold \nboth"


def test_unseen_text(spark):
    """Scripts, styles and comments hide what looks like markup, closed or not."""
    hidden = '<script>if (a < b) "</div>"</script><STYLE>div{}</style><!-- <div> -->'
    rows = messages_of(spark, export(message(1, f"one{hidden}two", span=False)))
    assert [r["content"] for r in rows] == ["one\ntwo"]
    assert messages_of(spark, export("<!-- never closed", message(1, "a"))) == []
    rows = messages_of(spark, export(message(1, "a"), "<script>", message(2, "b")))
    assert [r["message_id"] for r in rows] == ["1"]


@pytest.mark.parametrize("piece", ["<", "<script", "<!--", "<script>", '<a title="', "</", "<a", "<a '\">"])
def test_odd_text_takes_linear_time(piece):
    started = time.time()
    html_export._tree(piece * 5_000)
    assert time.time() - started < 1


def test_class_is_matched_by_token(spark):
    odd = message(1, "a").replace('"chatlog__header"', '"chatlog__header-x"')
    assert messages_of(spark, export(odd)) == []


def test_channels_include_empty_files(spark):
    rows = spark.createDataFrame(
        [("a.html", export(message(1, "x"), message(2, " "))), ("b.html", export())],
        "file_name string, value string",
    )
    found = html_channels(parse_html_files(rows)).orderBy("file_name").collect()
    assert [(r["file_name"], r["message_count"]) for r in found] == [("a.html", 1), ("b.html", 0)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("exports")
    bodies = [f"text {i} &lt;div&gt; <b>bold</b> tail\r\nline" for i in range(400)]
    many = [
        message(i, b, bot=i % 9 == 0, header=i % 7 != 0, time=STAMP if i % 2 else None)
        for i, b in enumerate(bodies)
    ]
    (root / "one.html").write_text(export(*many), newline="")
    (root / "My - Cat - two [5].html").write_text(export(*many[:30], entries=("x",)), newline="")
    (root / "empty.html").write_text(export())
    (root / "note.txt").write_text(export(*many[:3]))
    (root / "bad.html").write_bytes(b"\xff\xfe<html>" + export(many[1]).encode())
    (root / "sub").mkdir()
    (root / "sub" / "deep.html").write_text(export(*many[:3]))
    return str(root)


def contents(df):
    """Rows per file in document order, without the ordinal's value."""
    rows = df.drop("ordinal").collect()
    order = [tuple(r) for r in df.orderBy("file_name", "ordinal").drop("ordinal").collect()]
    assert len(rows) == len(order)
    return order


def test_directory_scan(spark, folder):
    found = html_messages(read_html_exports(spark, folder))
    assert {r[0] for r in found.select("file_name").distinct().collect()} == {
        "one.html", "My - Cat - two [5].html"
    }


def test_bad_file_is_reported(spark, folder):
    bad = html_errors(read_html_exports(spark, folder)).collect()
    assert [tuple(r) for r in bad] == [("bad.html", "not valid UTF-8")]


def test_deep_nesting_and_odd_containers(spark):
    box = '<div class="chatlog__message-container"{}><div class="chatlog__message"><div class="chatlog__message-primary"><div class="chatlog__header"><span class="chatlog__author">Ann</span></div><div class="chatlog__content">{}'
    inner = [box.format(a, f"m{i}" + "</div>" * 4) for i, a in enumerate([' data-message-id="1"', "", " data-message-id='3'"])]
    text = export(*inner, '<div data-message-id="9">no container</div>')
    assert [m["content"] for m in messages_of(spark, text)] == ["m0", "m1", "m2"]
    deep = export("<div>" * 5000, *inner)
    assert [m["content"] for m in messages_of(spark, deep)] == ["m0", "m1", "m2"]
    unclosed = export(*[box.format("", f"u{i}") for i in range(1200)])
    assert len(messages_of(spark, unclosed)) == 1200


def test_a_failing_file_leaves_the_others(spark, monkeypatch):
    def parse(text):
        if "boom" in text:
            raise ValueError("boom")
        return real(text)

    real = html_export._tree
    monkeypatch.setattr(html_export, "_tree", parse)
    rows = [r for n, t in (("a", "boom"), ("b", export(message(1, "x")))) for b in html_export._files_parser(False)(
        [pa.RecordBatch.from_pylist([{"file_name": n, "value": t}])]) for r in b.to_pylist()]
    assert [(r["file_name"], r["error"], r["content"]) for r in rows] == [
        ("a", "ValueError('boom')", None), ("b", None, None), ("b", None, "x")]


def test_continuations_are_kept_on_demand(spark):
    grouped = '<div class="chatlog__message-container" data-message-id="2"><div class="chatlog__message"><div class="chatlog__message-primary"><div class="chatlog__content">and more</div></div></div></div>'
    text = export(grouped, message(1, "hi", title="ann.real"), grouped, grouped)
    assert [m["content"] for m in messages_of(spark, text)] == ["hi"]
    rows = spark.createDataFrame([("f.html", text)], "file_name string, value string")
    kept = html_messages(parse_html_files(rows, keep_continuations=True)).orderBy("ordinal").collect()
    assert [(m["content"], m["author_name"]) for m in kept] == [("hi", "ann.real"), ("and more", "ann.real"), ("and more", "ann.real")]
    assert len({m["ts"] for m in kept}) == 1


def test_iso_titles_have_a_time(spark):
    rows = spark.createDataFrame([("f.html", export(message(1, "hi"))),], "file_name string, value string")
    raw = parse_html_files(rows).withColumn("time_title", F.lit("2024-05-06T07:08:09"))
    row = html_messages(raw).first()
    assert str(row["ts"]) == "2024-05-06 07:08:09" and row["ts_raw"] == "2024-05-06T07:08:09"


def files_read(df):
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().head()
    return node.metrics().get("numFiles").get().value()


def test_size_condition_prunes_files(spark, folder):
    """Only the matching files become input of the scan."""
    whole = files.whole_files(spark, folder, pathGlobFilter="*.html")
    assert files_read(whole.where(F.col("file_size") <= 20_000)) == 3


def test_file_names_keep_plus_signs(spark, tmp_path):
    (tmp_path / "a+b c%20.html").write_text(export(message(1, "x")))
    found = html_messages(read_html_exports(spark, str(tmp_path))).collect()
    assert [r["file_name"] for r in found] == ["a+b c%20.html"]
