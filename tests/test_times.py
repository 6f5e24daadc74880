"""Export times, ISO text and year ranges."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import times

# fixed values: the accepted shapes
FORMATS = [
    "%A, %B %d, %Y %I:%M %p", "%A, %B %d, %Y %I:%M:%S %p", "%m/%d/%Y %I:%M %p",
    "%Y-%m-%d %H:%M:%S",
]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(
    st.tuples(st.datetimes(datetime(1000, 1, 1), datetime(2400, 1, 1)), st.sampled_from(FORMATS)),
    min_size=20, max_size=40,
))
def test_formats(column_of, drawn):
    values = [moment.strftime(form) for moment, form in drawn]
    kept = [m.replace(microsecond=0, second=m.second if "%S" in form else 0) for m, form in drawn]
    assert column_of(times.parse_export_time, values) == kept


ODD = {
    "thursday, october 13, 2022 5:07 pm": datetime(2022, 10, 13, 17, 7),
    "Monday, October 13, 2022 12:00 AM": datetime(2022, 10, 13),
    "Friday, October 13, 2022 12:30:15 PM": datetime(2022, 10, 13, 12, 30, 15),
    "Thursday, October 13, 2022 5:07\u202fPM": datetime(2022, 10, 13, 17, 7),
    "Thursday,\u00a0October 13, 2022 5:07\u00a0PM": datetime(2022, 10, 13, 17, 7),
    "2/29/2024\u30001:00\u2009AM": datetime(2024, 2, 29, 1),
    "2024-1-2\u00a03:04:05": datetime(2024, 1, 2, 3, 4, 5),
    "October 13, 2022 5:07 PM": None, "Thursday, October 32, 2022 5:07 PM": None,
    "Thursday, October 13, 2022 13:07 PM": None, "2/29/2023 1:00 AM": None,
    "2024-01-02T03:04:05": None, "2024-01-02 24:00:00": None, "": None, "soon": None,
    "Thursday, October 13, 2022 5:07 PM ": None, "0000-01-01 00:00:00": None,
    "2024-01-01 10:10:60": None,
}


def test_odd_spellings(column_of):
    assert column_of(times.parse_export_time, list(ODD)) == list(ODD.values())


def test_iso_text(spark):
    moments = [
        datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 120000),
        datetime(2024, 1, 2), None,
    ]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(moments)], "i int, t timestamp_ntz")
    found = [r[1] for r in sorted(rows.select("i", times.iso_text(F.col("t"))).collect())]
    assert found == [m and m.isoformat() for m in moments]


def test_parse_iso(column_of):
    values = [
        "2025-01-01T00:00:00Z", "2024-12-31T23:59:59-05:00", "2025-06-01", "2025-06-01T10:20",
        "2025-06-01T10:20:30.123000", "2025-13-01T00:00:00", "yesterday", None,
    ]
    found = column_of(times.parse_iso, values)
    assert found == [
        datetime(2025, 1, 1), datetime(2024, 12, 31, 23, 59, 59), datetime(2025, 6, 1),
        datetime(2025, 6, 1, 10, 20), datetime(2025, 6, 1, 10, 20, 30, 123000), None, None, None,
    ]


def test_in_year_reaches_the_scan(spark, tmp_path):
    start = datetime(2024, 12, 31, 23)
    rows = [(start + timedelta(minutes=30 * i),) for i in range(6)] + [(None,)]
    spark.createDataFrame(rows, "ts timestamp_ntz").write.parquet(str(tmp_path / "t"))
    kept = spark.read.parquet(str(tmp_path / "t")).where(times.in_year(F.col("ts"), 2025))
    assert kept.count() == 4
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_epoch_millis(spark):
    rows = spark.createDataFrame([(0,), (None,), (1_665_680_820_123,)], "ms bigint")
    found = [r[0] for r in rows.select(times.from_epoch_millis(F.col("ms"))).collect()]
    assert found == [None, None, datetime(2022, 10, 13, 17, 7, 0, 123000)]
