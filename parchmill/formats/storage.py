"""Open, list and write files by URI inside a task."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from functools import lru_cache
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs

# URI schemes of Hadoop connectors and what Arrow calls them.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
_BLOCK = 1 << 20


@lru_cache(maxsize=64)
def _remote(scheme: str, authority: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{authority}/")


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it); a path without a scheme is local."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), uri
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, _, path = rest.removeprefix("//").partition("/")
    fs, base = _remote(scheme, authority)
    return fs, f"{base.rstrip('/')}/{path}"


def reachable(uri: str) -> bool:
    """Whether Python can use the file system of a URI by itself, without Spark."""
    try:
        resolve(uri)
    except (pa.ArrowException, OSError, ImportError):
        return False
    return True


class _Raw(io.RawIOBase):
    """An Arrow file as Python's readers want it: no place before its start."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        start = {io.SEEK_SET: 0, io.SEEK_CUR: self.file.tell(), io.SEEK_END: self.file.size()}
        if start[whence] + offset < 0:
            raise OSError("a place before the file's start")
        self.file.seek(start[whence] + offset)
        return self.file.tell()

    def close(self) -> None:
        self.file.close()
        super().close()


def open_file(uri: str) -> BinaryIO:
    """A file to read and seek in; only what is asked for is read, a block at a time."""
    fs, path = resolve(uri)
    return io.BufferedReader(_Raw(fs.open_input_file(path)), _BLOCK)


def qualified(uri: str) -> str:
    """The form in which Spark's file sources report a path."""
    fs, path = resolve(uri)
    return f"file:{os.path.abspath(path)}" if isinstance(fs, pafs.LocalFileSystem) else uri


class Entry(NamedTuple):
    """One entry of a folder. `kind` is file, folder or link (to a folder)."""

    path: str
    kind: str
    length: int = 0
    modified: float = 0.0
    problem: str | None = None


def _local_entry(uri: str, e: os.DirEntry) -> Entry:
    name = os.fsencode(e.name).decode("utf-8", "replace")
    path = f"{uri}/{name}"
    if e.is_dir():
        return Entry(path, "link" if e.is_symlink() else "folder")
    try:
        stat = e.stat()
    except OSError as error:  # a link to nothing
        return Entry(path, "file", problem=f"{type(error).__name__}: {error.strerror}")
    return Entry(path, "file", stat.st_size, stat.st_mtime)


def children(uri: str) -> Iterator[Entry]:
    """The entries of one folder. A folder that cannot be listed gives one entry
    that says so."""
    fs, path = resolve(uri)
    try:
        if isinstance(fs, pafs.LocalFileSystem):
            with os.scandir(path) as entries:
                yield from (_local_entry(uri, e) for e in entries)
            return
        for info in fs.get_file_info(pafs.FileSelector(path)):
            folder = info.type == pafs.FileType.Directory
            modified = info.mtime.timestamp() if info.mtime else 0.0
            kind = "folder" if folder else "file"
            yield Entry(f"{uri}/{info.base_name}", kind, info.size or 0, modified)
    except OSError as error:
        yield Entry(uri, "file", problem=f"{type(error).__name__}: {error.strerror}")
