"""Files of the data sources, opened through Arrow's file systems from the planner and from tasks."""

from __future__ import annotations

import re
import time

import pyarrow.fs as pafs

STORES = ("file", "s3", "gs", "gcs", "hdfs", "abfs", "abfss")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and the path in it; a path without a scheme is local."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, a folder's files or those of a comma-separated list, sorted."""
    found = []
    for one in path.split(","):
        store, inside = opened(one)
        info = store.get_file_info(inside)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(one)
        many = [info]
        if info.type == pafs.FileType.Directory:
            many = [f for f in store.get_file_info(pafs.FileSelector(inside, recursive=True)) if f.is_file and not re.search(r"(^|/)[._]", f.path[len(inside) :])]
        scheme = one[: -len(inside)] if one.endswith(inside) else ""
        found += [(scheme + f.path, f.size) for f in many]
    return sorted(found)


def begin(folder: str) -> None:
    """Makes the folder that the tasks of a write fill.  Tasks do not make it, so that one that outlives a failed write cannot bring it back."""
    store, inside = opened(folder)
    store.create_dir(inside)


def drop(folder: str, tries: int = 20) -> None:
    """Deletes a folder that tasks may still be writing to."""
    store, inside = opened(folder)
    for _ in range(tries):
        if store.get_file_info(inside).type != pafs.FileType.Directory:
            return
        try:
            store.delete_dir(inside)
        except OSError:  # a task has put a file into it meanwhile
            time.sleep(0.1)
