"""Order-dependent operators that stay parallel inside a hot group.

``previous_rows`` is a ROWS BETWEEN k PRECEDING AND 1 PRECEDING frame and
``global_index`` a running row number. A plain window sorts each group in one
task. Groups are counted first, and where one exceeds ``hot_rows``, it is cut:

* by time, where the order begins with a timestamp: a window runs per group and
  period of 30 days, and each of them gets the last k rows of the periods before
  it, however many of those are empty or short;
* by chunks of consecutive rows, where a period still exceeds ``hot_rows`` (rows
  without a time form one) or the order begins otherwise: the rows are
  range-partitioned by their whole order and stored, and each partition gets the last
  k rows (or the row count) of what lies before it.

The result is exactly that of the plain window. The input is evaluated once for the
counts, and when cut by time once more for the last rows of the periods.

The order columns must tell any two rows of a group apart; nulls sort first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType, BooleanType, DatetimeType, NumericType, StringType, TimestampType,
)

from threadloom.runtime import scratch_path

HOT_ROWS = 1_000_000
# A chunk of numbered rows holds about so many bytes at most.
CHUNK_BYTES = 64 << 20
# Counted from the epoch, so that periods follow the order in every time zone.
PERIOD_SECONDS = 30 * 86_400
# Offsets, one row per chunk, are broadcast up to this many chunks.
_BROADCAST_CHUNKS = 100_000
# The row's place inside its partition, in the lower bits of Spark's increasing ids.
_PLACE_BITS = 33


def _laid_out(df: DataFrame, by: list[str], parts: int) -> DataFrame:
    """``df`` stored in ``parts`` chunks of consecutive rows, with ``_chunk`` and ``_place``.

    Stored, so that every later use sees the same chunks, whatever is recomputed.
    """
    path = scratch_path(df.sparkSession, "ordered")
    ranged = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    ranged.withColumn("_number", F.monotonically_increasing_id()).write.parquet(path)
    number = F.col("_number")
    return df.sparkSession.read.parquet(path).select(
        *df.columns, F.shiftright(number, _PLACE_BITS).alias("_chunk"),
        (number % (1 << _PLACE_BITS)).alias("_place"),
    )


def _sizes(df: DataFrame, keys: list[str], period: Column) -> tuple[int, int, int]:
    """Rows of the largest group, of its largest period, and of the table."""
    periods = df.groupBy(*keys, period.alias("_period")).agg(F.count(F.lit(1)).alias("_n"))
    groups = periods.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.max("_n").alias("_most"))
    found = groups.agg(F.max("_n"), F.max("_most"), F.sum("_n")).first()
    return tuple(n or 0 for n in found)


def _by_period(valued: DataFrame, keys: list[str], order: list[str], k: int,
               period: Column, name: str) -> DataFrame:
    """``previous_rows`` with a window per group and period, and rows carried into each."""
    # Structs, since their null fields are equal in a join.
    tagged = valued.withColumn("_group", F.struct(F.struct(*keys).alias("keys"), period.alias("period")))
    others = [c for c in order if c not in keys]
    newest = Window.partitionBy("_group").orderBy(*[F.desc_nulls_last(c) for c in order])
    # The rank filter also runs before the shuffle (WindowGroupLimit): k rows per period move.
    tails = (
        tagged.select("_group", *keys, *others, "_value").withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= k).withColumn("_keys", F.col("_group.keys"))
    )
    in_time = Window.partitionBy("_keys").orderBy(*order)
    carried = (
        tails.withColumns({
            "_carried": F.collect_list(F.struct("_value")).over(in_time.rowsBetween(-k, -1)),
            "_earlier": F.lag("_group").over(in_time),
        })
        # the first of a period's last rows has only rows of earlier periods before it
        .where(F.col("_earlier").isNotNull() & (F.col("_earlier") != F.col("_group")))
        .select("_group", "_carried")
    )
    inside = Window.partitionBy("_group").orderBy(*order).rowsBetween(-k, -1)
    # The join finds its rows where the window has put them: one shuffle for both.
    framed = tagged.withColumn("_inside", F.collect_list(F.struct("_value")).over(inside)).join(
        carried, "_group", "left")
    earlier = F.coalesce("_carried", F.slice("_inside", 1, 0))
    room = F.lit(k) - F.size("_inside")
    rows = F.concat(F.slice(earlier, F.greatest(F.size(earlier) - room, F.lit(0)) + 1, room), F.col("_inside"))
    values = F.transform(F.filter(rows, lambda r: r["_value"].isNotNull()), lambda r: r["_value"])
    return framed.withColumn(name, values)


def previous_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    k: int,
    value: Column,
    name: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds array ``name``: ``value`` of the k rows before each row, oldest first.

    A row whose value is null uses up one of the k slots and adds nothing.
    """
    valued = df.withColumn("_value", value)
    timed = isinstance(df.schema[order[0]].dataType, TimestampType)
    period = F.floor(F.unix_seconds(order[0]) / PERIOD_SECONDS) if timed else F.lit(0)
    most, most_in_period, total = _sizes(df, keys, period)
    if most <= hot_rows:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-k, -1)
        return valued.withColumn(name, F.collect_list("_value").over(frame)).drop("_value")
    if timed and most_in_period <= hot_rows:
        return _by_period(valued, keys, order, k, period, name).select(*df.columns, name)

    chunk_rows = max(hot_rows // 2, 1)
    laid = _laid_out(valued, [*keys, *order], -(-total // chunk_rows))
    others = [c for c in order if c not in keys]
    # The rank filter also runs before the shuffle (WindowGroupLimit), so k rows per chunk move.
    from_end = F.row_number().over(Window.partitionBy("_chunk").orderBy(F.desc("_place")))
    tails = laid.select(*keys, *others, "_value", "_chunk", "_place").withColumn(
        "_rank", from_end
    ).where(F.col("_rank") <= k)
    row = F.struct(*[F.col(c) for c in others], F.col("_value"))
    in_group = Window.partitionBy(*keys).orderBy(*order)
    # One row per chunk. Rows carried into a chunk without their group are dropped below.
    following = tails.where(F.col("_rank") == 1).select(
        "_chunk", F.lead("_chunk").over(Window.orderBy("_chunk")).alias("_next")
    )
    carried = (
        tails.withColumn("_carry", F.collect_list(row).over(in_group.rowsBetween(1 - k, 0)))
        .where(F.col("_rank") == 1)
        .join(following.where(F.col("_next").isNotNull()), "_chunk")
        .select(*keys, F.col("_next").alias("_chunk"), F.explode("_carry").alias("_row"))
        .select(*keys, "_chunk", *[F.col("_row")[c].alias(c) for c in others],
                F.col("_row")["_value"].alias("_value"), F.lit(True).alias("_carried"))
    )
    both = laid.drop("_place").withColumn("_carried", F.lit(False)).unionByName(
        carried, allowMissingColumns=True
    )
    frame = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(-k, -1)
    return (
        both.withColumn(name, F.collect_list("_value").over(frame))
        .where(~F.col("_carried"))
        .select(*df.columns, name)
    )


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    def width(field) -> Column:
        if isinstance(field.dataType, (NumericType, DatetimeType, BooleanType)):
            return F.lit(8)
        held = F.col(f"`{field.name}`")
        plain = held if isinstance(field.dataType, (StringType, BinaryType)) else held.cast("string")
        return F.coalesce(F.octet_length(plain), F.lit(0)) + 8

    return sum((width(f) for f in df.schema), F.lit(0)).cast("bigint")


def global_index(
    df: DataFrame,
    order: list[str],
    name: str,
    hot_rows: int = HOT_ROWS,
    chunk_bytes: int | None = None,
) -> DataFrame:
    """Adds ``name``: the row's position (from 0) in the total order, without one global sort.

    Rows are cut into chunks by their number and by their bytes.
    """
    rows, size = df.agg(F.count(F.lit(1)), F.sum(_bytes(df))).first()
    parts = max(-(-rows // hot_rows), -(-(size or 0) // (chunk_bytes or CHUNK_BYTES)))
    if parts <= 1:
        # Counted: one task can number them.
        index = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1
        return df.withColumn(name, index.cast("bigint"))
    laid = _laid_out(df, order, parts)
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n")).select(
        "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    if parts <= _BROADCAST_CHUNKS:
        offsets = F.broadcast(offsets)
    return laid.join(offsets, "_chunk").select(
        *df.columns, (F.col("_offset") + F.col("_place")).cast("bigint").alias(name)
    )
