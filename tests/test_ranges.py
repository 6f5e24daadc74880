"""Exports read in ranges of bytes, and live messages from growing logs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.test_html_export import STAMP, contents, export, message
from threadloom.sources import html_ranges, message_log
from threadloom.sources.html_export import (
    html_channels, html_errors, html_messages, read_html_exports, with_channels,
)

HEAD = '<div class="chatlog__message"><div class="chatlog__message-primary"><div class="chatlog__header"><span class="chatlog__author" title="a<b">Ann</span></div><div class="chatlog__content">'
TAIL = "</div></div></div></div>\n"


def odd_messages():
    """Ids missing, single-quoted, before the class, on other elements; names and quotes of all kinds."""
    openings = [
        '<div class="chatlog__message-container">', "<div class='chatlog__message-container' data-message-id='s{}'>",
        '<div data-message-id="b{}" class="x chatlog__message-container y">', "<DIV CLASS=chatlog__message-container DATA-MESSAGE-ID=u{}>",
        '<div title="1 > 0" class="chatlog__message-container" data-message-id="q{}">',
        '<div\n  class="chatlog__message-container"\r\n  data-message-id="n{}"\n>',
    ]
    for i in range(120):
        yield openings[i % len(openings)].format(i) + HEAD + (
            f'é{i} 日本 <b data-message-id="7">bold</b> &lt;div class="chatlog__message-container"&gt; ' + "long " * (i % 40)) + TAIL
        if i % 9 == 0:
            yield '<div data-message-id="9" class="other chatlog__message-containers">no</div>'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("exports")
    many = [message(i, f"text {i} &lt;div&gt; <b>bold</b>\r\nline", bot=i % 9 == 0, header=i % 7 != 0,
                    time=STAMP if i % 2 else None) for i in range(300)]
    (root / "one.html").write_text(export(*many), newline="")
    (root / "odd.html").write_text(export(*odd_messages()), newline="")
    (root / "My - Cat - two [5].html").write_text(export(*many[:30], entries=("x",)), newline="")
    (root / "none.html").write_text(export())
    (root / "empty.html").write_text("")
    (root / "note.txt").write_text(export(*many[:3]))
    (root / "bad.html").write_bytes(export(many[1]).encode() + b"\xff" + export(*many[:40]).encode())
    return str(root)


def ranged(spark, folder, tmp_path, step):
    found = html_ranges.read_html_ranges(spark, folder, range_bytes=step)
    name = F.element_at(F.split("file_name", "/"), -1)
    found.withColumn("file_name", name).write.parquet(f"{tmp_path}/raw")
    return spark.read.parquet(f"{tmp_path}/raw")


@pytest.mark.parametrize("step", [1 << 25, 4096, 501])
def test_ranges_equal_the_whole_file_form(spark, folder, tmp_path, step):
    raw, whole = ranged(spark, folder, tmp_path, step), read_html_exports(spark, folder)
    parsed = with_channels(raw)
    assert contents(html_messages(parsed)) == contents(html_messages(whole))
    assert [tuple(r) for r in html_errors(raw).collect()] == [("bad.html", "not valid UTF-8")]
    assert sorted(map(tuple, html_channels(parsed).collect())) == sorted(map(tuple, html_channels(whole).collect()))


def test_one_export_in_many_tasks(spark, folder):
    found = html_ranges.read_html_ranges(spark, f"{folder}/one.html", range_bytes=8192)
    tasks = found.where("ordinal is not null").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 10 and max(r["count"] for r in tasks) < 40


def test_every_cut_gives_the_same_records(monkeypatch):
    data = export(*list(odd_messages())[:14], '<div class="chatlog__message-container" title="open').encode()

    def read(n, at):
        return data[at:at + n]

    monkeypatch.setattr(html_ranges, "STEP_BYTES", 50)
    whole = list(html_ranges.range_records(read, 0, len(data), len(data)))
    assert len(whole) > 10 and b"".join(r[2] for r in whole) == data
    for step in [*range(1, 60), 97, 1000, 3001]:
        found = [r for low, high in html_ranges.cut(0, len(data), step)
                 for r in html_ranges.range_records(read, low, high, len(data))]
        assert found == whole, step


def test_a_folder_without_exports(spark, tmp_path):
    assert html_ranges.read_html_ranges(spark, str(tmp_path)).collect() == []


# ---- message logs

def line(i, **fields):
    return json.dumps({"source": "live", "message_id": f"m{i}", "channel_name": "x", "content": f"é {i}",
                       "timestamp": "2024-05-06T07:08:09"} | fields)


def taken(spark, folder, base, **options):
    """What a run until the end of the logs adds to ``base``: (file, place, content) by batch."""
    stream = message_log.stream_message_log(spark, str(folder), **options)
    (stream.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
     .option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination(60))
    if not (base / "out").exists():
        return []
    rows = spark.read.parquet(f"{base}/out").collect()
    return sorted((r["batch"], r["file_name"], r["ordinal"], r["message_id"], r["content"]) for r in rows)


def test_logs_grow_between_and_during_lines(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    with open(logs / "a.jsonl", "w") as log:
        log.write(line(1) + "\n" + line(2) + "\n" + line(3)[:20])
    first = taken(spark, logs, tmp_path)
    size = len(line(1).encode()) + 1
    assert first == [(0, "a.jsonl", 0, "m1", "é 1"), (0, "a.jsonl", size, "m2", "é 2")]
    with open(logs / "a.jsonl", "a") as log:
        log.write(line(3)[20:] + "\n\n" + "no json\n")
    (logs / "b.jsonl").write_text(line(9) + "\n")
    (logs / "c.txt").write_text(line(8) + "\n")
    second = taken(spark, logs, tmp_path)
    assert [r[3] for r in second] == ["m1", "m2", "m3", None, "m9"]
    # a batch whose commit is lost reads the same ranges again, whatever has come since
    for name in ("1", ".1.crc"):
        (tmp_path / "check/commits" / name).unlink()
    with open(logs / "a.jsonl", "a") as log:
        log.write(line(4) + "\n")
    assert taken(spark, logs, tmp_path)[:len(second)] == second
    after = taken(spark, logs, tmp_path)
    assert after[:len(second)] == second and [r[3] for r in after[len(second):]] == ["m4"]


def test_every_cut_gives_the_same_lines(monkeypatch):
    rng = random.Random(1)
    lines = [b"x" * rng.choice([0, 1, 5, 40]) for _ in range(40)]
    data = b"\n".join(lines) + b"\n" + b"rest"
    monkeypatch.setattr(message_log, "STEP_BYTES", 7)
    end = message_log.last_line_end(lambda n, at: data[at:at + n], 0, len(data))
    assert end == len(data) - 4
    starts = [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]
    for first in (0, starts[7], end):
        for step in (1, 2, 3, 10, 33, 1000):
            found = [r for low, high in message_log.cut(first, end, step) for r in message_log.range_lines(
                lambda n, at: data[at:at + n], message_log.LogRange("f", low, high, first, end))]
            assert found == [(s, x) for s, x in zip(starts, lines) if s >= first]


def test_a_long_backlog_is_read_by_many_tasks(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text("".join(line(i) + "\n" for i in range(500)))
    assert [r[3] for r in taken(spark, logs, tmp_path, range_bytes=2000)] == [f"m{i}" for i in range(500)]
    reader = message_log.LogStreamReader({"path": str(logs), "rangebytes": "2000"})
    assert len(reader.partitions({}, reader.latestOffset())) > 20
    with pytest.raises(ValueError, match="was read up to"):
        reader.partitions({str(logs / "a.jsonl"): 10_000_000}, reader.latestOffset())
