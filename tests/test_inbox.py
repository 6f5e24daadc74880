"""Inbox directories: filters, names, times and odd files."""

import json
from datetime import datetime

import pytest

from threadloom.operators.messages import conversation_summary
from threadloom.sources.inbox import inbox_files, inbox_messages, inbox_participants

MS = 1_735_689_600_000  # 2025-01-01T00:00:00Z


def sent(content, sender="ann", ms=MS, **extra):
    fields = {"sender_name": sender, "timestamp_ms": ms, "content": content, **extra}
    return {k: v for k, v in fields.items() if v != "absent"}


@pytest.fixture(scope="module")
def inbox(tmp_path_factory):
    root = tmp_path_factory.mktemp("inbox")
    people = [{"name": "ann"}, {}, {"name": "Zoë"}]

    def put(directory, name, data):
        (root / directory).mkdir(exist_ok=True)
        text = data if isinstance(data, str) else json.dumps(data, ensure_ascii=False)
        (root / directory / name).write_text(text)

    put("conv_a", "message_1.json", {"participants": [], "messages": [sent("first")]})
    put("conv_a", "message_2.json", {"participants": people, "messages": [
        sent("  padded \n"), sent("   "), sent("absent"), sent(None),
        sent("Ann SENT an Attachment."), sent("Reacted 😂 to your message "),
        sent("Reacted slowly"), sent("reacted x to your message"),
        sent("a link", share={"link": "u"}), sent("null link", share=None),
        sent("no time", ms=0), sent("time missing", ms="absent"), sent("ms", ms=MS + 123),
        sent("nameless", sender="absent"),
    ]})
    put("conv_a", "message_10.json", {"messages": [sent("tenth")]})
    put("conv_a", "other.json", {"messages": [sent("not read")]})
    put(".hidden", "message_1.json", {"participants": people, "messages": [sent("hidden")]})
    put("empty", "message_1.json", {"participants": people, "messages": []})
    put("broken", "message_1.json", '{"participants": [{"name": "x"}], "messages": [{"conte')
    put("broken", "message_2.json", {"participants": people, "messages": [sent("fine")]})
    return str(root)


@pytest.fixture(scope="module")
def found(spark, inbox):
    rows = inbox_messages(inbox_files(spark, inbox)).collect()
    return {r["content"]: r.asDict() for r in rows}


def test_kept_messages(found):
    assert set(found) == {
        "first", "padded", "Reacted slowly", "reacted x to your message", "no time",
        "time missing", "ms", "nameless", "tenth", "fine",
    }


def test_names(found):
    assert found["padded"]["conversation_name"] == "ann, Unknown, Zoë"
    assert found["padded"]["conv_key"] == "instagram_ann, Unknown, Zoë"
    # message_1 and message_10 sort ahead of message_2, which lists the participants.
    assert found["first"]["conversation_name"] == found["tenth"]["conversation_name"] == ""
    assert found["nameless"]["author_name"] == found["nameless"]["author_id"] == "Unknown"


def test_times_and_ids(found):
    assert found["padded"]["ts"] == datetime(2025, 1, 1)
    assert found["padded"]["message_id"] == f"ig_{MS}"
    assert found["ms"]["ts_raw"] == "2025-01-01T00:00:00.123000"
    for name in ("no time", "time missing"):
        assert found[name]["ts"] is None and found[name]["ts_raw"] is None
        assert found[name]["message_id"].startswith("ig_")
    assert found["no time"]["message_id"] != found["time missing"]["message_id"]


def test_order_columns(found):
    assert found["padded"]["file_name"] == "conv_a/message_2.json"
    assert found["padded"]["ordinal"] == 0 and found["ms"]["ordinal"] == 12
    assert found["padded"]["source"] == "instagram" and found["padded"]["is_bot"] is False


def test_directory_keys(spark, inbox):
    rows = inbox_messages(inbox_files(spark, inbox), by_directory=True).collect()
    assert {r["conv_key"] for r in rows} == {"instagram_conv_a", "instagram_broken"}


def test_summary_leaves_out_empty_conversations(spark, inbox):
    files = inbox_files(spark, inbox)
    rows = conversation_summary(inbox_messages(files), inbox_participants(files)).collect()
    assert {r["conversation_dir"]: (r["message_count"], r["participants"]) for r in rows} == {
        "conv_a": (9, ["ann", None, "Zoë"]), "broken": (1, ["ann", None, "Zoë"]),
    }
