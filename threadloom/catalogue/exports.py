"""Conversations rendered as HTML exports and inbox files, to be read back.

A file holds 25 conversations and at most a thousand turns of each.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.catalogue.views import markdown, stamp, table
from threadloom.runtime import scratch_path
from threadloom.sources.ranges import file_system


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def _joined(glue: str) -> Column:
    ordered = F.sort_array(F.collect_list(F.struct("conv_id", "turn", "item")))
    return F.array_join(F.transform(ordered, lambda r: r["item"]), glue)


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").withColumns({
        "block": F.expr("conv_id div 25"), "part": F.expr("turn div 1000"), "ts": stamp(),
    })


def write_named(files: DataFrame, path: str) -> None:
    """Writes (name, value) rows as files of these names; the tasks write, so a repeat overwrites."""
    def write(batches):
        system, root = file_system(path)
        for batch in batches:
            for row in batch.to_pylist():
                folder, _, _ = row["name"].rpartition("/")
                system.create_dir(f"{root}/{folder}", recursive=True)
                with system.open_output_stream(f"{root}/{row['name']}") as file:
                    file.write(row["value"])
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["written"])

    named = files.select("name", F.col("value").cast("binary").alias("value"))
    named.mapInArrow(write, "written long").agg(F.sum("written")).collect()


def write_html(spark: SparkSession, sf: str) -> str:
    """Exports below a new path, named as the exporter does; one beside every third is no text.

    Odd blocks have no usable preamble. Later turns (from the seventh) come
    without header, users without title, and every text ends in an inline tag.
    """
    long_time = F.date_format("ts", "EEEE, MMMM d, yyyy h:mm a")
    title = F.when(F.col("role") == "user", "").otherwise(
        F.concat(F.lit(' title="'), "role", F.lit('"'))
    )
    tag = F.when(
        F.col("role") == "system", '<span class="chatlog__author-tag">BOT</span>'
    ).otherwise("")
    header = F.concat(
        F.lit('<div class="chatlog__header"><span class="chatlog__author" data-user-id="u-'),
        "role", F.lit('"'), title, F.lit("> "), "role", F.lit("\n</span>"), tag,
        F.lit('<span class="chatlog__timestamp" title="'), long_time, F.lit('">now</span></div>'),
    )
    item = F.concat(
        F.lit('<div class="chatlog__message-container " data-message-id="'),
        F.concat_ws("-", "conv_id", "turn"),
        F.lit('"><div class="chatlog__message"><div class="chatlog__message-primary">'),
        F.when(F.col("turn") < 6, header).otherwise(""),
        F.lit('<div class="chatlog__content"><span class="chatlog__markdown-preserve">\n'),
        _escaped(F.col("text")),
        F.lit("<em>end</em></span><br></div></div></div></div>\n"),
    )
    entry = '<div class="preamble__entry">'
    preamble = F.when(
        F.col("block") % 2 == 0,
        F.concat(F.lit(f"<html><body>{entry}Guild</div>{entry}Talk / block-"), "block",
                 F.lit("</div>\n")),
    ).otherwise(f"<html><body>{entry}Guild</div>\n")
    name = F.concat(
        F.lit("Guild - Talk - block-"), "block", F.lit(" ["), "part", F.lit("].html")
    )
    files = _turns(spark, sf).withColumn("item", item).groupBy("block", "part").agg(
        F.concat(F.first(preamble), _joined("")).alias("value")
    ).select("block", name.alias("name"), F.concat("value", F.lit("</body></html>")).cast("binary").alias("value"))
    broken = files.where("block % 3 = 2").select(
        F.concat(F.lit("Broken "), "name").alias("name"), F.concat(F.unhex(F.lit("FF")), "value").alias("value"))
    path = scratch_path(spark, "html")
    write_named(files.select("name", "value").unionByName(broken), path)
    return path


def write_inbox(spark: SparkSession, sf: str) -> str:
    """Inbox files below a new path; every third directory has one more that is broken off.

    A dot directory repeats the first block. The first file of a directory lists no participants. By turn: the third is
    an attachment note, the fourth a reaction, the fifth carries a null share
    and the sixth has no time. Systems send without a name.
    """
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    content = (
        F.when(F.col("turn") == 2, F.concat("role", F.lit(" Sent an Attachment.")))
        .when(F.col("turn") == 3, F.lit("Reacted :) to your message "))
        .otherwise(F.concat(F.lit(" "), "text", F.lit("\n")))
    )
    message = F.to_json(F.struct(
        F.when(F.col("role") != "system", F.col("role")).alias("sender_name"),
        F.when(F.col("turn") == 5, 0).otherwise(at).alias("timestamp_ms"),
        content.alias("content"),
    ))
    item = F.when(
        F.col("turn") == 4, F.regexp_replace(message, r"\}\z", ',"share":null}')
    ).otherwise(message)
    number = F.expr("1 + (conv_id % 25) div 9 + 3 * part")
    files = (
        _turns(spark, sf).withColumns({"item": item, "number": number})
        .groupBy("block", "number")
        .agg(_joined(",").alias("items"))
    )
    people = F.when(
        F.col("number") > 1,
        F.concat(F.lit('[{"name":"block '), "block", F.lit('"},{}]')),
    ).otherwise("[]")
    path = scratch_path(spark, "inbox")
    named = files.select(
        "block", F.concat(F.lit("d"), "block", F.lit("/message_"), "number", F.lit(".json")).alias("name"),
        F.concat(F.lit('{"participants":'), people, F.lit(',"messages":['), "items",
                 F.lit("]}")).alias("value"),
    )
    broken = files.where("block % 3 = 1").select(
        F.concat(F.lit("d"), "block", F.lit("/message_99.json")).alias("name"),
        F.lit('{"messages":[').alias("value")).distinct()
    hidden = named.where("block = 0").select(F.concat(F.lit("."), "name").alias("name"), "value")
    write_named(named.select("name", "value").unionByName(broken).unionByName(hidden), path)
    return path


def write_logs(spark: SparkSession, sf: str, path: str, turns: Column) -> None:
    """The turns of a condition as further lines of a live client's logs."""
    found = _turns(spark, sf).where(turns).select(F.to_json(F.struct(
        F.lit("live").alias("source"), F.concat_ws("-", "conv_id", "turn").alias("message_id"),
        F.col("role").alias("author_id"), F.col("role").alias("author_name"), F.col("text").alias("content"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        (F.col("role") == "system").alias("is_bot"), F.lit("Guild").alias("guild_name"),
        F.concat(F.lit("c"), "conv_id").alias("channel_name"),
    )))
    found.write.mode("append").text(path)


def write_docs(spark: SparkSession, sf: str) -> str:
    """A documentation tree below a new path: markdown of fifty documents per file."""
    pages = markdown(spark, sf).select(
        F.regexp_extract("path", r"d(\d+)\.md", 1).cast("bigint").alias("doc_id"), "value"
    )
    ordered = F.sort_array(F.collect_list(F.struct("doc_id", "value")))
    files = pages.groupBy(F.expr("doc_id div 50").alias("guide")).agg(
        F.array_join(F.transform(ordered, lambda d: d["value"]), "\n").alias("value")
    )
    path = scratch_path(spark, "docs")
    files.write.partitionBy("guide").text(f"{path}/source")
    return path
