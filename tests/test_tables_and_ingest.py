"""Writers, readers and the ingest plans."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from test_html_export import export, message
from threadloom.operators.messages import MESSAGE_COLUMNS, MESSAGE_SCHEMA
from threadloom.operators.pairs import training_pairs
from threadloom.plans.ingest import ingest_html, ingest_inbox
from threadloom.runtime import estimated_bytes, scratch_path, shared_dir
from threadloom.sinks import tables as sinks
from threadloom.sources import tables


def rows(spark, *values):
    return spark.createDataFrame(
        [tuple(v.get(c) for c in MESSAGE_COLUMNS) for v in values], MESSAGE_SCHEMA
    )


def test_shared_folder(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_dir(spark) == folder
    assert scratch_path(spark, "x").startswith(folder) and spark.sparkContext.getCheckpointDir()
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert 0 < estimated_bytes(spark.range(10)) < 1000


def test_sources_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "m")
    sinks.write_messages(rows(spark, {"source": "discord", "content": "a"}), path)
    for text in ("b", "c"):
        sinks.write_messages(rows(spark, {"source": "instagram", "content": text}), path)
    found = tables.read_messages(spark, path)
    assert sorted((r["source"], r["content"]) for r in found.collect()) == [
        ("discord", "a"), ("instagram", "c"),
    ]
    plan = found.where("source = 'discord'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan


def files_read(df):
    """How many files the scans of a query opened when it ran."""
    df.collect()
    return sum(leaf.metrics().get("numFiles").get().value() for leaf in scans(df._jdf.queryExecution().executedPlan()))


def scans(node):
    if node.getClass().getSimpleName() == "FileSourceScanExec":
        return [node]
    if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return scans(node.executedPlan())
    inner = [node.plan()] if node.getClass().getSimpleName().endswith("QueryStageExec") else [
        node.children().apply(i) for i in range(node.children().size())]
    return [leaf for child in inner for leaf in scans(child)]


def test_a_year_reads_its_files_only(spark, tmp_path):
    """A third source is stored later, one is stored again with fewer years."""
    def said(source, year, n):
        at = datetime(year, 3, 1, 0, n) if year else None
        return {"source": source, "conv_key": f"k-{source}", "message_id": f"{source}{year}-{n}", "content": f"t{n}", "ts": at,
                "author_id": "me" if n % 2 else "you", "author_name": "a", "file_name": "f", "ordinal": n}

    path = str(tmp_path / "m")
    years = [None, *range(2016, 2026)]
    stored = [said(s, y, n) for s in ("discord", "instagram") for y in years for n in range(4)]
    sinks.write_messages(rows(spark, *stored), path)
    early = tables.read_messages(spark, path)
    sinks.write_messages(rows(spark, *[said("discord", y, 1) for y in (2024, 2025)], said("other", 2025, 0)), path)
    found = tables.read_messages(spark, path)
    assert early.count() == 88 and found.count() == 44 + 3
    assert [r["message_id"] for r in found.where("source = 'discord'").orderBy("ts").collect()] == ["discord2024-1", "discord2025-1"]
    whole, year = training_pairs(early, ["me"]), training_pairs(early, ["me"], 2025)
    assert files_read(whole) >= 22 and files_read(year) <= files_read(whole) / 10
    plain = training_pairs(early.drop("ts_year"), ["me"], 2025)
    assert sorted(map(tuple, year.collect())) == sorted(map(tuple, plain.collect())) and year.count() == 4
    assert tables.read_messages(spark, str(tmp_path / "none")).count() == 0


def test_messages_as_a_stream(spark, tmp_path):
    path = str(tmp_path / "feed")
    for text in "abc":
        rows(spark, {"content": text, "author_id": "x"}).coalesce(1).write.mode("append").parquet(path)
    sizes = []
    stream = tables.stream_messages(spark, path, max_files=2).writeStream.foreachBatch(
        lambda batch, number: sizes.append(batch.count())
    ).option("checkpointLocation", str(tmp_path / "check"))
    stream.trigger(availableNow=True).start().awaitTermination()
    assert sizes == [2, 1]


def test_exchange_json(spark, tmp_path):
    messages = [
        {"message_id": "1", "author_id": "7", "author_name": "ann", "content": "hi",
         "timestamp": "2025-01-01T00:30:00Z", "is_bot": False, "guild_name": "g", "channel_name": "c"},
        {"message_id": "ig_2", "author_id": "bob", "author_name": "bob", "content": "yo",
         "timestamp": "2024-12-31T23:30:00.120000", "is_bot": False, "source": "instagram",
         "conversation_name": "ann, bob"},
        {"message_id": "3", "content": "when", "timestamp": "last week"},
    ]
    (tmp_path / "all.json").write_text(json.dumps(messages, indent=2))
    found = tables.read_message_json(spark, str(tmp_path / "all.json")).orderBy("ordinal").collect()
    assert [r["conv_key"] for r in found] == [
        "discord_g_c", "instagram_ann, bob", "discord_unknown_unknown",
    ]
    assert [r["ts"] for r in found] == [
        datetime(2025, 1, 1, 0, 30), datetime(2024, 12, 31, 23, 30, 0, 120000), None,
    ]
    assert found[2]["ts_raw"] == "last week"


def test_chat_json(spark, tmp_path):
    one = {"conversations": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}
    for name in ("train", "val"):
        (tmp_path / f"{name}.json").write_text(json.dumps([one, one], indent=2))
    paths = [str(tmp_path / f"{n}.json") for n in ("train", "val")]
    found = tables.read_chat(spark, *paths, multi_line=True)
    assert found.count() == 4 and found.first()["conversations"][1]["content"] == "b"


def test_ingest(spark, tmp_path):
    exports, inbox, out = tmp_path / "exports", tmp_path / "inbox", str(tmp_path / "out")
    exports.mkdir()
    (exports / "a.html").write_text(export(message(1, "hi"), message(2, "yo", author="Bob")))
    (exports / "b.html").write_text(export(entries=("Guild", "empty")))
    (exports / "c.html").write_bytes(b"\xff" + export(message(3, "lost")).encode())
    for name in ("one", "two"):
        (inbox / name).mkdir(parents=True)
        (inbox / name / "message_1.json").write_text(json.dumps({
            "participants": [{"name": name}],
            "messages": [{"sender_name": name, "timestamp_ms": 1, "content": "x"}] * 2,
        }))
    first = ingest_html(spark, str(exports), out)
    assert first.count() == 2
    for _ in range(2):
        both = ingest_inbox(spark, str(inbox), out)
    assert both.groupBy("source").count().orderBy("source").collect() == [
        ("discord", 2), ("instagram", 4),
    ]
    read = spark.read.json
    assert sorted((r["channel_name"], r["message_count"]) for r in read(f"{out}/channels").collect()) == [
        ("empty", 0), ("general", 2),
    ]
    assert read(f"{out}/totals").first().asDict() == {"total_messages": 2, "processed_files": 2}
    assert read(f"{out}/inbox_totals").first().asDict() == {
        "total_messages": 4, "processed_conversations": 2,
    }
    assert [r["file_name"] for r in read(f"{out}/errors").collect()] == ["c.html"]
    assert sorted((r["conversation_name"], r["message_count"]) for r in read(f"{out}/conversations").collect()) == [
        ("one", 2), ("two", 2),
    ]
    assert read(f"{out}/by_conversation").where(F.col("conv_key") == "discord_Guild_general").count() == 2


def test_hot_conversation_is_written_by_several_tasks(spark, tmp_path):
    made = spark.range(60_000).select(
        F.lit("discord").alias("source"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string").substr(1, 1)).alias("conv_key"),
        F.sha2(F.col("id").cast("string"), 512).alias("content"),
    ).repartition(16)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        sinks.write_by_conversation(made, str(tmp_path / "c"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    bucket = spark.range(1).select(sinks.conversation_bucket(F.lit("hot"))).first()[0]
    hot = list((tmp_path / "c" / "source=discord" / f"bucket={bucket}").glob("part-*"))
    assert len(hot) > 1 and spark.read.json(str(tmp_path / "c")).count() == 60_000


def test_conversation_keys_of_any_length(spark, tmp_path):
    made = spark.createDataFrame([("s", "k" * 1000, "a"), ("s", "k" * 1000, "b"), ("s", "x/y", "c")], "source string, conv_key string, content string")
    sinks.write_by_conversation(made, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).where(F.length("conv_key") == 1000).count() == 2


def test_ids_repeated_in_one_add(spark, tmp_path):
    row = [("a", "x", {"type": "t"}), ("a", "x", {"type": "t"})]
    made = spark.createDataFrame(row, "id string, document string, metadata struct<type:string>")
    for _ in range(2):
        sinks.add_to_collection(made, str(tmp_path / "v"))
        assert spark.read.parquet(str(tmp_path / "v")).count() == 1
