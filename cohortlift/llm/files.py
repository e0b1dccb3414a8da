"""Reading and writing files in the shared folder from inside tasks.

A task writes under a name of its own and returns that name; only what the
finished tasks returned is ever read, so a task that runs twice does no harm.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def write_file(folder: str, suffix: str, data: bytes) -> str:
    """Write ``data`` to a new file and return its address."""
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    system, path = _open(uri)
    with system.open_output_stream(path, compression=None) as out:
        out.write(data)
    return uri


class Writer:
    """A file written piece by piece."""

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
        system, path = _open(self.uri)
        self.out, self.size = system.open_output_stream(path, compression=None), 0

    def write(self, data: bytes) -> int:
        """Returns where the data begins."""
        start = self.size
        self.out.write(data)
        self.size += len(data)
        return start

    def close(self) -> None:
        self.out.close()


def make_folder(uri: str) -> None:
    system, path = _open(uri)
    system.create_dir(path, recursive=True)


def read_range(uri: str, start: int = 0, length: int | None = None) -> bytes:
    system, path = _open(uri)
    with system.open_input_file(path) as source:
        return source.read_at(source.size() - start if length is None else length, start)
