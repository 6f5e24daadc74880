"""Tables in versions: rebuilt and added to while they are read.

A version is a list of data folders in a small file of its own, written last. A reader that has
opened a version keeps reading it, whatever is published after; nothing is written in place.
Two writers cannot publish the same version: the later one finds it taken, looks
at what the other has added, and goes on from there. Old versions stay until ``forget`` removes
them.

    table/_versions/00000002.json    {"folders": ["a1…", "b2…/source=x"]}
    table/_data/_part=a1…/…          one write's rows, by partition columns

A version may hold a part of a folder: the directories of some of its first partition column's values.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from threadloom.runtime import _hadoop_path, drop_path, path_exists

_PART = "_part"


class Version(NamedTuple):
    number: int
    folders: tuple[str, ...]


NOTHING = Version(0, ())


def _version_file(path: str, number: int) -> str:
    return f"{path}/_versions/{number:08d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions there are, oldest first."""
    if not path_exists(spark, f"{path}/_versions"):
        return []
    target, files = _hadoop_path(spark, f"{path}/_versions")
    names = [f.getPath().getName() for f in files.listStatus(target)]
    return sorted(int(n[:-len(".json")]) for n in names if n.endswith(".json") and n[0] not in "._")


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A version by its number, the newest without; ``NOTHING`` where there is none."""
    known = versions(spark, path)
    if number is not None:
        if number not in known:
            raise FileNotFoundError(f"{path} has no version {number}")
        known = [number]
    if not known:
        return NOTHING
    target, files = _hadoop_path(spark, _version_file(path, known[-1]))
    stream = files.open(target)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Version(known[-1], tuple(json.loads(text)["folders"]))


def publish(spark: SparkSession, path: str, before: Version, folders: tuple[str, ...]) -> bool:
    """Makes ``folders`` the version after ``before``; false if that version exists already."""
    # written whole under another name first; the renaming fails where the name is taken
    unnamed, files = _hadoop_path(spark, f"{path}/_versions/.{uuid.uuid4().hex}")
    stream = files.create(unnamed, False)
    stream.write(bytearray(json.dumps({"folders": list(folders)}).encode()))
    stream.close()
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    named = files.makeQualified(hadoop.Path(_version_file(path, before.number + 1)))
    plainly = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        hadoop.FileContext.getFileContext(named.toUri(), conf).rename(files.makeQualified(unnamed), named, plainly)
    except Exception as failure:
        files.delete(unnamed, False)
        if files.exists(named):
            return False
        raise failure
    return True


def drop_version(spark: SparkSession, path: str, number: int) -> None:
    drop_path(spark, _version_file(path, number))


def write_folder(df: DataFrame, path: str, by: list[str]) -> str:
    """Writes rows into a folder that no version holds yet."""
    name = uuid.uuid4().hex
    df.write.partitionBy(*by).parquet(f"{path}/_data/{_PART}={name}")
    return name


def read_folders(spark: SparkSession, path: str, folders: tuple[str, ...], schema: str | None = None) -> DataFrame:
    base = f"{path}/_data"
    reader = spark.read.option("basePath", base)
    if schema is not None:
        reader = reader.schema(f"{schema}, {_PART} string")
    return reader.parquet(*(f"{base}/{_PART}={f}" for f in folders)).drop(_PART)


def read_snapshot(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The newest version, or the one asked for, as it was when this was called."""
    found = version(spark, path, number)
    if not found.folders:
        raise FileNotFoundError(f"{path} has no version")
    return read_folders(spark, path, found.folders)


def replace_snapshot(df: DataFrame, path: str, by: list[str]) -> Version:
    """Publishes ``df`` as the whole table."""
    spark, folder = df.sparkSession, write_folder(df, path, by)
    while True:
        before = version(spark, path)
        if publish(spark, path, before, (folder,)):
            return Version(before.number + 1, (folder,))


def replace_parts(df: DataFrame, path: str, by: list[str]) -> Version:
    """Publishes the table with ``df`` in place of its rows of those values of ``by[0]`` that ``df`` has."""
    spark, folder = df.sparkSession, write_folder(df, path, by)
    target, files = _hadoop_path(spark, f"{path}/_data/{_PART}={folder}")
    parts = [e.getPath().getName() for e in files.listStatus(target) if e.isDirectory()]
    new = tuple(f"{folder}/{p}" for p in sorted(parts))
    while True:
        before = version(spark, path)
        kept = tuple(f for f in before.folders if f.partition("/")[2] not in parts)
        if publish(spark, path, before, kept + new):
            return Version(before.number + 1, kept + new)


def add_to_snapshot(df: DataFrame, path: str, key: str, by: list[str],
                    between: Callable[[], None] | None = None) -> Version:
    """Publishes the table with those rows of ``df`` whose key it lacks, one row per key.

    ``between`` is called once the rows are written and before they are published.
    """
    spark = df.sparkSession
    before = version(spark, path)
    new = df.dropDuplicates([key])
    if before.folders:
        new = new.join(read_folders(spark, path, before.folders).select(key), key, "left_anti")
    folder = write_folder(new, path, by)
    while True:
        if between is not None:
            between()
        if publish(spark, path, before, (*before.folders, folder)):
            return Version(before.number + 1, (*before.folders, folder))
        # another writer was faster: leave out what it has brought, or all it holds if it has rebuilt the table
        known, before = before, version(spark, path)
        since = tuple(f for f in before.folders if f not in known.folders)
        rebuilt = not set(known.folders) <= set(before.folders)
        mine = df.dropDuplicates([key]) if rebuilt else read_folders(spark, path, (folder,))
        if since:
            mine = mine.join(read_folders(spark, path, since).select(key), key, "left_anti")
        folder = write_folder(mine.select(*df.columns), path, by)


def forget(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes all but the newest ``keep`` versions and the folders that only they hold.

    Not while writers are at work: what they have not published yet would be taken for left over.
    """
    known = versions(spark, path)
    going = known[:-keep] if keep else known
    held = {f.partition("/")[0] for n in known[len(going):] for f in version(spark, path, n).folders}
    for n in going:
        drop_version(spark, path, n)
    target, files = _hadoop_path(spark, f"{path}/_data")
    dropped = 0
    for entry in files.listStatus(target) if files.exists(target) else []:
        if entry.getPath().getName().partition("=")[2] not in held:
            drop_path(spark, entry.getPath().toString())
            dropped += 1
    return dropped
