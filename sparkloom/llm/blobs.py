"""Binary files that tasks write into, and read from, the shared folder.

A file is written under a name of its own attempt and then moved to its final
name, which depends on the data alone: a repeated or speculative task replaces
the file by an equal one, and a failed one leaves no half-written file behind.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame


def write_blob(uri: str, *parts: bytes) -> int:
    """Writes the parts as one file at ``uri``; the number of bytes."""
    filesystem, path = fs.FileSystem.from_uri(uri)
    filesystem.create_dir(path.rpartition("/")[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.tmp"
    with filesystem.open_output_stream(attempt, compression=None) as out:
        for part in parts:
            out.write(part)
    filesystem.move(attempt, path)
    return sum(len(part) for part in parts)


def read_blob(uri: str) -> bytes:
    """A file's stored bytes, whatever its name ends with."""
    filesystem, path = fs.FileSystem.from_uri(uri)
    with filesystem.open_input_stream(path, compression=None) as f:
        return f.read()


def spread_files(manifest: DataFrame, most: int = 20_000) -> DataFrame:
    """The rows of a written manifest, dealt so that about one file falls to a task."""
    return manifest.repartition(max(1, min(most, manifest.count())), "path")
