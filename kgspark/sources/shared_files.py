"""Small files and listings in the folder that all executors share, by any of Arrow's file systems."""

from __future__ import annotations

import uuid
from typing import Optional
from urllib.parse import urlparse

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def exists(uri: str) -> bool:
    store, path = locate(uri)
    return store.get_file_info(path).type != fs.FileType.NotFound


def files_below(uri: str, suffix: str = "") -> list[str]:
    """Paths below a folder, relative to it, in ascending order; hidden and unfinished files are left out."""
    store, path = locate(uri)
    found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    names = (f.path[len(path.rstrip("/")) + 1 :] for f in found if f.type == fs.FileType.File)
    return sorted(n for n in names if n.endswith(suffix) and not any(p[0] in "._" for p in n.split("/")))


def folders_in(uri: str) -> list[str]:
    store, path = locate(uri)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name[0] not in "._")


def read_text(uri: str) -> Optional[str]:
    """Content of a small file, or None where there is none."""
    if not exists(uri):
        return None
    store, path = locate(uri)
    with store.open_input_file(path) as f:
        return f.read().decode()


def write_text(uri: str, content: str) -> None:
    """Writes a small file whole: it appears under its name by one rename, replacing what was there."""
    store, path = locate(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(content.encode())
    store.move(part, path)
