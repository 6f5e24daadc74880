"""Files as byte ranges, for sources whose records Spark's readers cannot find.

Storage is reached through pyarrow's file systems: local and mounted folders, and the object
stores and HDFS that pyarrow has a client for.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase
from typing import NamedTuple

from pyarrow import fs

RANGE_BYTES = 32 << 20
# Read at a time beyond a range, to complete its last record.
STEP_BYTES = 1 << 18


class File(NamedTuple):
    path: str
    size: int


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str, glob: str = "*", recursive: bool = False) -> list[File]:
    """The files of a folder in order of their paths, or the one file ``path``.

    Names that begin with ``_`` or ``.`` are hidden, as in Spark's own sources.
    """
    system, root = file_system(path)
    found = system.get_file_info(root)
    if found.type == fs.FileType.File:
        return [File(found.path, found.size)]
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    inside = system.get_file_info(fs.FileSelector(root, recursive=recursive))
    files = [
        File(f.path, f.size) for f in inside
        if f.type == fs.FileType.File and f.base_name[0] not in "_." and fnmatchcase(f.base_name, glob)
    ]
    return sorted(files)


def cut(start: int, stop: int, step: int) -> Iterator[tuple[int, int]]:
    for low in range(start, stop, step):
        yield low, min(low + step, stop)
