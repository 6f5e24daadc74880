"""Live channels: history per trigger, prompts, replies and image jobs.

What must survive between batches, the last messages of every channel, is Spark's own keyed
state: it is versioned with the checkpoint, so a repeated batch sees what its first run
saw. Every task first cuts its rows of a channel to the last few, so a busy channel
sends a few rows a task to its state and no more. Channels share states by their hash, so a batch
of many channels takes few calls. The state hands out what it held of the batch's channels before
the batch, and history is then an ordinary batch job over these rows and the batch's own, in
which a busy channel is split between tasks like any hot group. Results are written under the
batch's number, so a repeated batch overwrites its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from threadloom.functions import fixed
from threadloom.operators.prompts import assemble_prompts, system_text, with_history
from threadloom.plans import replies as reply_plan
from threadloom.sinks.snapshots import Version, drop_version, publish, versions

# A channel's last rows, packed; null in the messages themselves.
_TAIL, _TIME, _BUCKET = "_tail", "_time", "_bucket"
# Channels are dealt to so many states: one call, sort and write for many channels of a batch.
BUCKETS = 1024
# So many rows of a task wait before its channels are cut again.
_WAITING_ROWS = 1 << 16


def _batch(path: str, number: int) -> str:
    return f"{path}/batch={number}"


def _channel_starts(rows: pa.Table, channel: list[str]) -> np.ndarray:
    """Where, in rows sorted by channel, another channel begins."""
    starts = np.zeros(rows.num_rows, bool)
    starts[:1] = True
    for name in channel:
        codes = rows[name].combine_chunks().dictionary_encode(null_encoding="encode")
        starts[1:] |= np.diff(codes.indices.to_numpy()) != 0
    return np.flatnonzero(starts)


def newest(rows: pa.Table, channel: list[str], order: list[str], limit: int) -> pa.Table:
    """The last ``limit`` rows of each channel, sorted by channel and order, nulls first."""
    keys = [(c, "ascending") for c in dict.fromkeys((*channel, *order))]
    rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start")).combine_chunks()
    starts = _channel_starts(rows, channel)
    sizes = np.diff(np.append(starts, rows.num_rows))
    to_end = np.repeat(starts + sizes, sizes) - np.arange(rows.num_rows)
    return rows.filter(pa.array(to_end <= limit))


def _packed(rows: pa.Table) -> bytes:
    batches = rows.combine_chunks().to_batches()
    return batches[0].serialize().to_pybytes()


def _unpacked(packed: list[bytes], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(p), schema) for p in packed], schema)


def _micros(rows: pa.Table, name: str) -> np.ndarray:
    """Times in microseconds, 0 for those without."""
    return pc.fill_null(rows[name].cast(pa.timestamp("us", "UTC")).cast(pa.int64()), 0).to_numpy()


def _ends(rows: pa.Table, channel: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The place of each channel's last row, and the rows per channel, in rows sorted by channel."""
    ends = np.append(_channel_starts(rows, channel), rows.num_rows)
    return ends[1:] - 1, np.diff(ends)


def _talking(held: pa.Table, fresh: pa.Table, channel: list[str]) -> pa.Table:
    """The rows of ``held`` whose channel has a row in ``fresh``."""
    both = pa.concat_tables([
        held.append_column("_fresh", pa.array(np.zeros(held.num_rows, bool))),
        fresh.append_column("_fresh", pa.array(np.ones(fresh.num_rows, bool))),
    ])
    both = both.take(pc.sort_indices(both, sort_keys=[(c, "ascending") for c in channel])).combine_chunks()
    marked = both["_fresh"].to_numpy()
    starts = _channel_starts(both, channel)
    sizes = np.diff(np.append(starts, both.num_rows))
    talking = np.repeat(np.logical_or.reduceat(marked, starts), sizes)
    return both.filter(pa.array(talking & ~marked)).drop_columns("_fresh").combine_chunks()


def with_tails(messages: DataFrame, channel: list[str], order: list[str],
               limit: int = fixed.HISTORY_LIMIT, keep: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The stream ``messages`` and, packed in ``_tail``, its channels' last rows before each batch.

    ``keep`` ("30 days") forgets channels whose last message is older, by the first order
    column, than the newest of all by more; a message as late gets no history either.
    Without it every channel is kept. ``buckets`` of channels share a state each; a
    checkpoint stays with the number it began with.
    """
    columns = list(dict.fromkeys([*channel, *order, "author_name", "content", "is_bot"]))
    slim = messages.select(*columns)
    schema = to_arrow_schema(slim.schema)
    tail_schema = StructType().add(_BUCKET, "integer").add(_TAIL, "binary")
    if keep is not None:
        tail_schema = tail_schema.add(_TIME, "timestamp")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = schema.append(pa.field(_BUCKET, pa.int32()))
        held, waiting, many = wide.empty_table(), [], 0
        for batch in batches:
            waiting.append(pa.Table.from_batches([batch]).cast(wide))
            many += batch.num_rows
            # as many rows as are held wait, so that the held ones are sorted a few times only
            if many > max(held.num_rows, _WAITING_ROWS):
                held, waiting, many = newest(pa.concat_tables([held, *waiting]), channel, order, limit), [], 0
        held = newest(pa.concat_tables([held, *waiting]), channel, order, limit)
        held = held.take(pc.sort_indices(held, sort_keys=[(_BUCKET, "ascending")])).combine_chunks()
        ends, sizes = _ends(held, [_BUCKET])
        rows = held.drop_columns(_BUCKET)
        packed = [_packed(rows.slice(e - n + 1, n)) for e, n in zip(ends.tolist(), sizes.tolist())]
        arrays = [held[_BUCKET].combine_chunks().take(pa.array(ends)), pa.array(packed, pa.binary())]
        if keep is not None:
            times = held[order[0]].cast(pa.timestamp("us", "UTC"))
            last = [pc.max(times.slice(e - n + 1, n)) for e, n in zip(ends.tolist(), sizes.tolist())]
            arrays.append(pa.array([x.as_py() for x in last], pa.timestamp("us", "UTC")))
        yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in tail_schema])

    def since(rows: pa.Table, time: int) -> pa.Table:
        """Without the channels whose last row, of rows sorted by channel and order, is before ``time``."""
        ends, sizes = _ends(rows, channel)
        return rows.filter(pa.array(np.repeat(_micros(rows, order[0])[ends] >= time, sizes))).combine_chunks()

    def hold(state: GroupState, rows: pa.Table) -> None:
        if not rows.num_rows:
            if state.exists:
                state.remove()
            return
        state.update((_packed(rows),))
        if keep is not None:
            first = int(_micros(rows, order[0])[_ends(rows, channel)[0]].min()) // 1000
            state.setTimeoutTimestamp(max(first, state.getCurrentWatermarkMs() + 1))

    def carry(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _unpacked([bytes(state.get[0])] if state.exists else [], schema)
        late = 1000 * state.getCurrentWatermarkMs() if keep is not None else 0
        if late > 0:
            held = since(held, late)  # idle for too long, but not dropped yet
        if state.hasTimedOut:
            hold(state, held)
            return
        found = [_unpacked([bytes(p)], schema) for part in parts for p in part[_TAIL]]
        if late > 0:
            found = [in_time(f, late) for f in found]
        fresh = pa.concat_tables([schema.empty_table(), *found])
        if held.num_rows and fresh.num_rows:
            tails = _talking(held, fresh, channel)
            if tails.num_rows:
                yield pd.DataFrame({_TAIL: [_packed(tails)]})
        hold(state, newest(pa.concat_tables([held, fresh]), channel, order, limit))

    def in_time(rows: pa.Table, late: int) -> pa.Table:
        """Without the channels of one task that are as late as the watermark; those without a time stay."""
        ends, sizes = _ends(rows, channel)
        last = rows[order[0]].combine_chunks().take(pa.array(ends))
        kept = (_micros(rows, order[0])[ends] > late) | last.is_null().to_numpy(zero_copy_only=False)
        return rows.filter(pa.array(np.repeat(kept, sizes)))

    bucket = F.pmod(F.xxhash64(*channel), F.lit(buckets)).cast("int")
    tails, timeout = slim.withColumn(_BUCKET, bucket).mapInArrow(cut, tail_schema), GroupStateTimeout.NoTimeout
    if keep is not None:
        tails, timeout = tails.withWatermark(_TIME, keep), GroupStateTimeout.EventTimeTimeout
    carried = tails.groupBy(_BUCKET).applyInPandasWithState(
        carry, f"{_TAIL} binary", f"{_TAIL} binary", "append", timeout)
    return messages.withColumn(_TAIL, F.lit(None).cast("binary")).unionByName(carried, allowMissingColumns=True)


def history_step(batch: DataFrame, channel: list[str], order: list[str],
                 limit: int = fixed.HISTORY_LIMIT, **options) -> DataFrame:
    """The messages of a batch of ``with_tails`` with ``history``, earlier batches included."""
    columns = list(dict.fromkeys([*channel, *order, "author_name", "content", "is_bot"]))
    fresh = batch.where(F.col(_TAIL).isNull()).drop(_TAIL)
    slim = StructType([fresh.schema[c] for c in columns])
    schema = to_arrow_schema(slim)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tails in batches:
            for packed in tails.column(0):
                yield pa.ipc.read_record_batch(pa.py_buffer(packed.as_py()), schema)

    carried = batch.where(F.col(_TAIL).isNotNull()).select(_TAIL).mapInArrow(unpacked, slim)
    known = fresh.withColumn("_fresh", F.lit(True)).unionByName(
        carried.withColumn("_fresh", F.lit(False)), allowMissingColumns=True)
    return with_history(known, channel, order, limit, **options).where("_fresh").drop("_fresh")


def _each_batch(messages: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):
    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            step(batch, number)
        finally:
            batch.unpersist()

    return messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def history_stream(messages: DataFrame, is_trigger, out: str, checkpoint: str,
                   channel: list[str], order: list[str],
                   limit: int = fixed.HISTORY_LIMIT, keep: str | None = None, **options):
    """Writes each triggering message with its history below ``out``; returns the writer."""

    def step(batch: DataFrame, number: int) -> None:
        seen = history_step(batch, channel, order, limit, **options)
        seen.where(is_trigger).write.mode("overwrite").parquet(_batch(out, number))

    return _each_batch(with_tails(messages, channel, order, limit, keep), step, checkpoint)


def committed(spark: SparkSession, out: str) -> int:
    """The last batch below ``out`` of which all results are written; -1 before the first."""
    return max(versions(spark, out), default=0) - 1


def sent(spark: SparkSession, out: str, kind: str) -> DataFrame:
    """The ``replies`` or ``image_jobs`` of the batches that are wholly written."""
    return spark.read.parquet(f"{out}/{kind}").where(F.col("batch") <= committed(spark, out))


def reply_stream(messages: DataFrame, contexts: Callable[[DataFrame], DataFrame],
                 generate: Callable[[DataFrame], DataFrame], bot_id: str, command: str,
                 assistant_name: str, out: str, checkpoint: str,
                 channel: list[str], order: list[str],
                 limit: int = fixed.HISTORY_LIMIT,
                 max_chars: int = fixed.MAX_REPLY_CHARS, keep: str | None = None):
    """Live messages to ``out/replies`` and ``out/image_jobs``; returns the writer.

    A batch's replies and image jobs count once both are written: read them with ``sent``. A
    batch that counts already is not answered again.

    ``contexts`` turns (query_id, text) requests into (query_id, contexts), as
    ``mixed_context`` does after embedding them. ``generate`` adds ``raw_reply``
    to rows with a ``prompt``.
    """

    def answer(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if committed(spark, out) >= number:
            return
        seen = history_step(batch, channel, order, limit)
        pulled = reply_plan.triggers(seen, bot_id, command).withColumn(
            "request_id", F.concat_ws("/", "message_id", "trigger")
        )
        # Written once: both the search and the prompts start from the requests.
        pulled.write.mode("overwrite").parquet(_batch(f"{out}/requests", number))
        requests = spark.read.parquet(_batch(f"{out}/requests", number))
        asked = requests.select(
            F.col("request_id").alias("query_id"), F.col("user_text").alias("text")
        )
        prompted = assemble_prompts(requests, contexts(asked), system_text(assistant_name))
        replied = reply_plan.replies(generate(prompted), assistant_name, max_chars)
        replied.write.mode("overwrite").parquet(_batch(f"{out}/replies", number))
        sent = spark.read.parquet(_batch(f"{out}/replies", number))
        reply_plan.image_jobs(sent).write.mode("overwrite").parquet(
            _batch(f"{out}/image_jobs", number)
        )
        publish(spark, out, Version(number, ()), ())
        if number:
            drop_version(spark, out, number)

    return _each_batch(with_tails(messages, channel, order, limit, keep), answer, checkpoint)
