"""Binary files in the folder that all executors share, by any of Arrow's file systems (file, hdfs, s3, gs)."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    store, path = locate(uri)
    store.create_dir(path, recursive=True)


class Output:
    """A file that appears under its name only when whole, so a repeated or speculative task does no harm."""

    def __init__(self, uri: str):
        self.store, self.path = locate(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.stream = self.store.open_output_stream(self.part)
        self.offset = 0

    def write(self, data: bytes) -> int:
        """Writes and returns the offset at which the data begin."""
        at = self.offset
        self.stream.write(data)
        self.offset += len(data)
        return at

    def close(self) -> None:
        self.stream.close()
        self.store.move(self.part, self.path)


class Ranges:
    """Reads byte ranges, one open file at a time."""

    def __init__(self):
        self.uri, self.file = None, None

    def size(self, uri: str) -> int:
        self._open(uri)
        return self.file.size()

    def read(self, uri: str, offset: int, length: int) -> bytes:
        self._open(uri)
        return self.file.read_at(length, offset)

    def _open(self, uri: str) -> None:
        if self.uri != uri:
            self.close()
            store, path = locate(uri)
            self.uri, self.file = uri, store.open_input_file(path)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.uri, self.file = None, None
