"""Files in the shared folder, opened from tasks through ``pyarrow.fs``."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from pyarrow import fs
from pyspark import TaskContext


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    store, path = open_fs(uri)
    store.create_dir(path, recursive=True)


def attempt_name(suffix: str) -> str:
    """A file name no other attempt of this task uses."""
    task = TaskContext.get()
    number = task.partitionId() if task else os.getpid()
    return f"part-{number:06d}-{uuid.uuid4().hex}{suffix}"


def write_manifest(uri: str, rows: list[dict[str, Any]]) -> None:
    """List the files of finished tasks; files of lost attempts are not in it
    and are never read."""
    store, path = open_fs(f"{uri}/_manifest.json")
    with store.open_output_stream(path) as out:
        out.write(json.dumps(rows).encode())


def read_manifest(uri: str, missing: Any = ...) -> list[dict[str, Any]]:
    """The rows of a manifest; ``missing`` where there is none."""
    store, path = open_fs(f"{uri}/_manifest.json")
    if missing is not ... and store.get_file_info(path).type == fs.FileType.NotFound:
        return missing
    with store.open_input_stream(path) as got:
        return json.loads(got.read())


def list_files(uri: str, suffix: str) -> list[tuple[str, int]]:
    """Paths and sizes of a folder's files, by name."""
    store, path = open_fs(uri)
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    kept = [x for x in found if x.type == fs.FileType.File and x.path.endswith(suffix)]
    return sorted((f"{uri.rstrip('/')}/{x.path[len(path.rstrip('/')) + 1:]}", x.size) for x in kept)
