"""Timestamps as they appear in exports, parsed independently of the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: English month and weekday names, and the accepted shapes ---
_MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
_SPACES = r"[\s\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
_WEEKDAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
_CLOCK12 = r"(1[0-2]|0?[1-9]):([0-5]?\d)"
_LONG = (
    rf"(?i)^(?:{_WEEKDAYS}),{_SPACES}({'|'.join(_MONTHS)}){_SPACES}(\d{{1,2}}),{_SPACES}(\d{{4}}){_SPACES}"
    rf"{_CLOCK12}(?::([0-5]?\d))?{_SPACES}([AP]M)\z"
)
_SLASHED = rf"(?i)^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_SPACES}{_CLOCK12}{_SPACES}([AP]M)\z"
_DASHED = rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}}){_SPACES}(\d{{1,2}}):([0-5]?\d):([0-5]?\d)\z"


def _part(text: Column, pattern: str, group: int) -> Column:
    found = F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    return found.cast("int")


def _hour24(hour: Column, half: Column) -> Column:
    return hour % 12 + F.when(F.upper(half) == "PM", 12).otherwise(0)


def _stamp(year, month, day, hour, minute, second) -> Column:
    made = F.try_make_timestamp_ntz(year, month, day, hour, minute, second.cast("decimal(16,6)"))
    return F.when(year > 0, made)


def parse_export_time(text: Column) -> Column:
    """The four export formats as timestamp_ntz; null when none of them fits.

    ``Weekday, Month d, yyyy h:mm AM`` (seconds optional), ``m/d/yyyy h:mm AM``
    and ``yyyy-mm-dd hh:mm:ss``.
    """
    month_name = F.lower(F.regexp_extract(text, _LONG, 1))
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), month_name)
    long_form = _stamp(
        _part(text, _LONG, 3), month.cast("int"), _part(text, _LONG, 2),
        _hour24(_part(text, _LONG, 4), F.regexp_extract(text, _LONG, 7)),
        _part(text, _LONG, 5), F.coalesce(_part(text, _LONG, 6), F.lit(0)),
    )
    slashed = _stamp(
        _part(text, _SLASHED, 3), _part(text, _SLASHED, 1), _part(text, _SLASHED, 2),
        _hour24(_part(text, _SLASHED, 4), F.regexp_extract(text, _SLASHED, 6)),
        _part(text, _SLASHED, 5), F.lit(0),
    )
    dashed = _stamp(*[_part(text, _DASHED, g) for g in range(1, 7)])
    return (
        F.when(F.rlike(text, F.lit(_LONG)), long_form)
        .when(F.rlike(text, F.lit(_SLASHED)), slashed)
        .when(F.rlike(text, F.lit(_DASHED)), dashed)
    )


def iso_text(ts: Column) -> Column:
    """ISO text as Python prints it: ``T`` separator, no fraction or six digits."""
    text = F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))
    return F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)


def parse_iso(text: Column) -> Column:
    """ISO text as written; a zone suffix is dropped, not applied. Null when malformed."""
    bare = F.regexp_replace(text, r"(?:Z|[+-]\d{2}:?\d{2})\z", "")
    stamp = F.when(F.rlike(bare, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}){1,2}(\.\d{1,6})?)?\z")), bare)
    return stamp.try_cast("timestamp_ntz")


def from_epoch_millis(millis: Column) -> Column:
    """Epoch milliseconds to wall-clock time in the session zone; 0 and null give null."""
    return F.when(millis != 0, F.timestamp_millis(millis)).cast("timestamp_ntz")


def in_year(ts: Column, year: int) -> Column:
    """A range on the bare column, so the scan can push it down or prune partitions."""
    start = F.lit(f"{year:04d}-01-01 00:00:00").cast("timestamp_ntz")
    end = F.lit(f"{year + 1:04d}-01-01 00:00:00").cast("timestamp_ntz")
    return (ts >= start) & (ts < end)
