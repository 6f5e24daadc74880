"""Frames and positions, cut into chunks or not, against plain Python."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from threadloom.operators.ordered import global_index, previous_rows


def made(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, "c"])
        when = rng.choice([None, *range(12)])
        rows.append((key, when, i, None if rng.random() < 0.3 else f"v{i}"))
    schema = "key string, t int, id int, v string"
    return rows, spark.createDataFrame(rows, schema).repartition(5)


def expected(rows, k):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(row[0], []).append(row)
    return {
        row[2]: [p[3] for p in group[max(0, i - k):i] if p[3] is not None]
        for group in groups.values() for i, row in enumerate(group)
    }


@pytest.mark.parametrize("k", [1, 2, 7])
@pytest.mark.parametrize("hot_rows", [None, 3, 40])
def test_previous_rows(spark, k, hot_rows):
    rows, df = made(spark, 300, k)
    options = {} if hot_rows is None else {"hot_rows": hot_rows}
    found = previous_rows(df, ["key"], ["t", "id"], k, F.col("v"), "before", **options)
    assert found.columns == [*df.columns, "before"]
    assert {r["id"]: r["before"] for r in found.collect()} == expected(rows, k)


def test_chunks_smaller_than_the_frame(spark):
    """Carried rows reach over several chunks."""
    rows, df = made(spark, 120, 3)
    found = previous_rows(
        df, ["key"], ["t", "id"], 20, F.col("v"), "before", hot_rows=2
    )
    assert {r["id"]: r["before"] for r in found.collect()} == expected(rows, 20)


def test_hot_group_is_spread(spark):
    rows = spark.range(20000).select(F.lit("one").alias("key"), F.col("id"))
    found = previous_rows(
        rows, ["key"], ["id"], 1, F.col("id"), "before", hot_rows=1000
    )
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan and len(sizes) > 1
    assert max(r["count"] for r in sizes) < 15000


def timed(n, seed, spread):
    """Rows of a few keys; months without rows, periods of one row, rows without a time, and ties."""
    rng = random.Random(seed)
    start = datetime(2024, 10, 20, 23, 30, tzinfo=UTC)
    rows = []
    for i in range(n):
        days = rng.choice([0, 1, 2, 30, 31, 400, 401, 402, 403, 1200, 1230, 1260, 1290, 1320]) * spread
        when = None if rng.random() < 0.05 else start + timedelta(days=days, seconds=rng.choice([0, 0, 5, 86_399]))
        rows.append((rng.choice(["hot", "hot", "hot", "b", None]), when, i, None if rng.random() < 0.3 else f"v{i}"))
    return rows


@pytest.mark.parametrize("k", [1, 2, 9, 60])
@pytest.mark.parametrize("zone", ["UTC", "America/St_Johns"])
def test_rows_carried_over_empty_periods(spark, k, zone):
    rows = timed(400, k, 1)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(rows, "key string, ts timestamp, id int, v string").repartition(6)
        found = previous_rows(df, ["key"], ["ts", "id"], k, F.col("v"), "before", hot_rows=120)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "_carried" in plan and "_chunk" not in plan
        assert found.columns == [*df.columns, "before"]
        got = {r["id"]: r["before"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    keyed = [(key, when and when.timestamp(), i, v) for key, when, i, v in rows]
    assert got == expected(keyed, k)


def test_a_crowded_period_is_cut_into_chunks(spark):
    rows = timed(300, 5, 0)
    df = spark.createDataFrame(rows, "key string, ts timestamp, id int, v string").repartition(6)
    found = previous_rows(df, ["key"], ["ts", "id"], 4, F.col("v"), "before", hot_rows=20)
    assert "_chunk" in found._jdf.queryExecution().optimizedPlan().toString()
    keyed = [(key, when and when.timestamp(), i, v) for key, when, i, v in rows]
    assert {r["id"]: r["before"] for r in found.collect()} == expected(keyed, 4)


def test_periods_move_each_row_once(spark):
    """One shuffle of all rows for window and join; the other three move the last k rows of each period or less."""
    day = F.timestamp_seconds(F.col("id") * 3600)
    df = spark.range(24 * 365 * 4).select(F.lit("one").alias("key"), day.alias("ts"), "id")
    found = previous_rows(df, ["key"], ["ts", "id"], 2, F.col("id"), "before", hot_rows=5000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert found.where(F.size("before") < 2).count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 4 and plan.count("WindowGroupLimit") == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "key string, ts timestamp, id int")
    assert previous_rows(df, ["key"], ["ts", "id"], 2, F.col("id"), "before").count() == 0


@pytest.mark.parametrize("hot_rows", [None, 10, 90])
def test_global_index(spark, hot_rows):
    rows, df = made(spark, 250, 9)
    options = {} if hot_rows is None else {"hot_rows": hot_rows}
    found = global_index(df, ["t", "id"], "place", **options)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    assert {r["id"]: r["place"] for r in found.collect()} == {
        row[2]: i for i, row in enumerate(order)
    }


def test_long_rows_are_numbered_in_chunks(spark):
    """Few rows, but more bytes than one task is to read."""
    rows = spark.range(400).select(
        F.expr("400 - id").alias("id"), F.expr("repeat('x', 5000)").alias("v"), F.array(F.lit(None).cast("string")).alias("a"))
    found = global_index(rows, ["id"], "place", chunk_bytes=200_000)
    assert found.columns == ["id", "v", "a", "place"] and "_chunk" in found._jdf.queryExecution().analyzed().toString()
    assert [(r["id"], r["place"]) for r in found.orderBy("id").collect()] == [(i + 1, i) for i in range(400)]
