"""Files in the shared folder, opened from tasks by their URI."""

from __future__ import annotations

import os
import re
import uuid

import pyarrow.fs as pafs
from pyspark import TaskContext


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path, and the path there."""
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return pafs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))


def read_range(source, start: int, length: int) -> bytes:
    source.seek(start)
    return source.read(length)


def new_file(folder: str, suffix: str) -> str:
    """A name that no other attempt of the task uses: readers go by the names that the winning attempt returned."""
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    return f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{suffix}"
