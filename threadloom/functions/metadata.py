"""The metadata struct shared by every document of a collection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = [
    "type", "message_id", "author_id", "author_name", "channel_name", "guild_name",
    "timestamp", "title", "file_path", "source",
]


def metadata(**values: Column) -> Column:
    """All fields in order, null where no value is given."""
    null = F.lit(None)
    return F.struct(*[values.get(f, null).cast("string").alias(f) for f in FIELDS])
