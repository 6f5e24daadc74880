"""Keys, filters, statistics, pairs and splits."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from threadloom.operators import messages as msg
from threadloom.operators.pairs import (
    chat_examples,
    exact_split,
    hash_split,
    render_chat,
    split_counts,
    training_pairs,
)
from threadloom.plans.training import prepare_datasets


def table(spark, rows):
    """Rows given as dicts; missing columns are null."""
    filled = [tuple(r.get(c) for c in msg.MESSAGE_COLUMNS) for r in rows]
    return spark.createDataFrame(filled, msg.MESSAGE_SCHEMA)


def chat(key, minute, author, text, n, year=2025, bot=False):
    return {
        "conv_key": key, "ts": datetime(year, 3, 1) + timedelta(minutes=minute),
        "author_id": f"id-{author}", "author_name": author, "content": text, "is_bot": bot,
        "message_id": f"{key}{n}", "file_name": "f", "ordinal": n,
    }


def test_conversation_key(spark):
    rows = [
        {"source": "instagram", "conversation_name": "a, b"}, {"source": "instagram"},
        {"source": "discord", "guild_name": "g", "channel_name": "c"}, {"guild_name": "g"}, {},
    ]
    found = table(spark, rows).select(msg.conversation_key()).collect()
    assert [r[0] for r in found] == [
        "instagram_a, b", "instagram_unknown", "discord_g_c", "discord_g_unknown",
        "discord_unknown_unknown",
    ]


def test_author_filter(spark):
    rows = [
        {"author_id": "1", "author_name": "x"}, {"author_name": "me"},
        {"author_id": "1", "is_bot": True}, {"author_id": "2"}, {},
    ]
    ids = msg.identifiers("1", "me", "", None)
    assert ids == ["1", "me"]
    found = table(spark, rows).select(msg.from_author(ids)).collect()
    assert [r[0] for r in found] == [True, True, False, False, False]


def test_note_filters(column_of):
    texts = ["You SENT AN attachment.", "Reacted x to your message", "reacted x to your message",
             "Reacted", "hi"]
    assert column_of(msg.is_attachment_note, texts) == [True, False, False, False, False]
    assert column_of(msg.is_reaction_note, texts) == [False, True, False, False, False]


def test_statistics_of_nothing(spark):
    none = table(spark, [])
    assert msg.year_counts(none, 2025).collect()[0]["percent"] is None
    assert tuple(msg.corpus_totals(none).collect()[0]) == (0, 0)
    assert msg.source_counts(none).collect() == []


def test_year_percentage_is_floored(spark):
    rows = [chat("k", 0, "a", "x", i, year=2025 if i < 2 else 2024) for i in range(3)]
    rows[0]["source"] = "instagram"
    assert msg.year_counts(table(spark, rows), 2025).collect()[0].asDict() == {
        "total": 3, "in_year": 2, "discord_in_year": 1, "instagram_in_year": 1, "percent": 66,
    }


def test_merge_fills_missing_columns(spark):
    left = spark.createDataFrame([("a", 1)], "x string, y int")
    right = spark.createDataFrame([("b", 2.0), ("b", 2.0)], "x string, z double")
    found = sorted(map(tuple, msg.merge_messages(left, right).collect()), key=repr)
    assert found == [("a", 1, None), ("b", None, 2.0), ("b", None, 2.0)]


def pairs_of(df, **options):
    found = training_pairs(df, ["me"], **options).orderBy("conv_key", "ts", "ordinal").collect()
    return [(r["instruction"], r["response"]) for r in found]


def test_pair_rules(spark):
    rows = [
        chat("a", 0, "me", "alone first", 0),
        chat("a", 1, "bob", " hi ", 1),
        chat("a", 2, "me", " yo\n", 2),
        chat("a", 3, "bot", "beep", 3, bot=True),
        chat("a", 4, "bob", " \n", 4),
        chat("a", 5, "me", "after a blank", 5),
        chat("a", 6, "bob", "", 6),
        chat("a", 7, "bob", None, 7),
        chat("a", 8, "me", "nothing but blanks", 8),
        chat("a", 9, "me", "  ", 9),
        chat("b", 0, "me", "single", 0),
    ]
    rows.append(chat("a", 10, None, "nameless", 10))
    rows.append(chat("a", 11, "me", "end", 11))
    assert pairs_of(table(spark, rows)) == [
        ("me: alone first\nbob: hi", "yo"),
        ("bot: beep", "after a blank"),
        ("Unknown: nameless", "end"),
    ]


def test_ties_keep_export_order(spark):
    rows = [chat("a", 0, "x", f"m{i}", i) for i in range(3)] + [chat("a", 0, "me", "r", 3)]
    random.Random(1).shuffle(rows)
    assert pairs_of(table(spark, rows)) == [("x: m1\nx: m2", "r")]


def test_year_comes_before_the_frame(spark):
    rows = [
        chat("a", 0, "x", "old", 0, year=2024), chat("a", 0, "me", "first of year", 1),
        chat("a", 1, "x", "new", 2), chat("a", 2, "me", "reply", 3),
        chat("b", 0, "x", "old", 0, year=2024), chat("b", 0, "me", "no context", 1),
    ]
    assert pairs_of(table(spark, rows), year=2025) == [("me: first of year\nx: new", "reply")]


def reference_pairs(rows, year, k=2):
    groups, made = {}, []
    for r in rows:
        groups.setdefault(r["conv_key"], []).append(r)
    for group in groups.values():
        if len(group) < 2:
            continue
        kept = sorted(
            (r for r in group if r["ts"].year == year), key=lambda r: (r["ts"], r["ordinal"])
        )
        for i, r in enumerate(kept):
            lines = [
                f"{p['author_name']}: {p['content'].strip()}"
                for p in kept[max(0, i - k):i] if p["content"].strip()
            ]
            if r["author_name"] == "me" and not r["is_bot"] and lines and r["content"].strip():
                made.append(("\n".join(lines), r["content"].strip()))
    return sorted(made)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot", [{}, {"hot_rows": 5}])
def test_pairs_against_restatement(spark, seed, hot):
    rng = random.Random(seed)
    rows = [
        chat(rng.choice("aaaabc"), rng.randrange(20), rng.choice(["me", "x", "y"]),
             rng.choice([f"t{n}", " ", f" s{n}\n"]), n, rng.choice([2024, 2025]),
             rng.random() < 0.2)
        for n in range(150)
    ]
    df = table(spark, rows).repartition(4)
    assert sorted(pairs_of(df, year=2025, **hot)) == reference_pairs(rows, 2025)


def examples(spark, n):
    rows = [chat("k", i, "x" if i % 2 else "me", f"t{i}", i) for i in range(n)]
    return chat_examples(training_pairs(table(spark, rows), ["me"]))


def test_chat_examples_and_text(spark):
    row, = examples(spark, 3).collect()
    assert [(t["role"], t["content"]) for t in row["conversations"]] == [
        ("user", "me: t0\nx: t1"), ("assistant", "t2"),
    ]
    text = spark.createDataFrame([row]).select(render_chat(F.col("conversations"))).collect()[0][0]
    assert text == (
        "<|im_start|>user\nme: t0\nx: t1<|im_end|>\n<|im_start|>assistant\nt2<|im_end|>\n"
    )


@pytest.mark.parametrize("n,ratio", [(3, 0.9), (21, 0.9), (101, 0.5), (41, 1.0), (41, 0.0)])
def test_exact_split_counts(spark, n, ratio):
    made = examples(spark, n)
    total = made.count()
    split = exact_split(made, ratio, seed=4)
    counts = {r["split"]: r["n_examples"] for r in split_counts(split).collect()}
    assert counts.get("train", 0) == int(total * ratio)
    assert sum(counts.values()) == total
    assert split.select("example_id").distinct().count() == total


def test_exact_split_inside_one_prefix(spark):
    """Equal digests up to the prefix are still cut exactly."""
    rows = spark.range(50).select(F.lit("same").alias("example_id"))
    assert exact_split(rows, 0.9).where("split = 'train'").count() == 45


def test_hash_split_is_reproducible(spark):
    made = spark.range(4000).select(F.col("id").cast("string").alias("example_id"))
    first = {tuple(r) for r in hash_split(made, 0.9, 1).collect()}
    again = {tuple(r) for r in hash_split(made.repartition(7), 0.9, 1).collect()}
    other = {tuple(r) for r in hash_split(made, 0.9, 2).collect()}
    assert first == again != other
    assert 0.88 < sum(s == "train" for _, s in first) / 4000 < 0.92


@pytest.mark.parametrize("exact", [False, True])
def test_prepare_datasets(spark, tmp_path, exact):
    rows = [chat("k", i, "x" if i % 2 else "me", f"t{i}", i) for i in range(60)]
    out = str(tmp_path / "chat")
    found = prepare_datasets(table(spark, rows), ["me"], 2025, out, exact=exact)
    assert found.count() == 29
    assert {p.name for p in (tmp_path / "chat").iterdir()} >= {"split=train", "split=val"}
    if exact:
        assert spark.read.json(f"{out}/split=train").count() == 26
