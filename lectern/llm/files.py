"""Files that tasks write to, and read from, the folder all executors share.

A file gets its name by a rename when it is whole, and the name and content depend on the
partition alone, so a task that runs again puts the same file in the same place.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame


def located(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


@contextmanager
def new_file(uri: str) -> Iterator:
    """A stream to a file that appears under its name only if the block ends well."""
    store, path = located(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(draft, compression=None) as out:
        yield out
    store.move(draft, path)


def stream(uri: str):
    """A sequential reader."""
    store, path = located(uri)
    return store.open_input_stream(path, compression=None)


def random_access(uri: str):
    store, path = located(uri)
    return store.open_input_file(path)


def remove(uri: str) -> None:
    store, path = located(uri)
    store.delete_dir(path)


def one_task_each(manifest: DataFrame) -> DataFrame:
    """The rows of a small stored manifest, each for a task of its own."""
    return manifest.repartition(max(1, manifest.count()))
