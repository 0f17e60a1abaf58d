"""Positional reads of local paths and of any URI that Arrow's file systems reach, on the driver and on executors."""

from __future__ import annotations

import glob
import os
from urllib.parse import unquote, urlparse

from .layout import DtaError


def _split(path: str):
    """(Arrow file system or None for the local one, path in it)."""
    scheme = urlparse(path).scheme
    if scheme in ("", "file") or len(scheme) == 1:
        return None, unquote(urlparse(path).path) if scheme == "file" else path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


#: Reads without a byte that are borne (fixed value).
RETRIES = 2


class Source:
    """read(offset, n) gives exactly n bytes or fails."""

    def __init__(self, path: str) -> None:
        system, inner = _split(path)
        self.path = path
        self.file = open(inner, "rb") if system is None else system.open_input_file(inner)
        self.file.seek(0, 2)
        self.size = self.file.tell()

    def read(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        out, empty = self.file.read(n), 0
        while len(out) < n and empty <= RETRIES:  # remote files may give less than there is
            more = self.file.read(n - len(out))
            out, empty = out + more, empty + (not more)
        if len(out) < n:
            raise DtaError(f"Unexpected EOF while reading {n} bytes at offset {offset}")
        return out

    def __enter__(self) -> Source:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


class Bytes:
    """The same over a file's content in memory."""

    def __init__(self, data: bytes, path: str = "") -> None:
        self.data, self.path, self.size = memoryview(data), path, len(data)

    def read(self, offset: int, n: int) -> bytes:
        if offset < 0 or offset + n > self.size:
            raise DtaError(f"Unexpected EOF while reading {n} bytes at offset {offset}")
        return bytes(self.data[offset : offset + n])

    def __enter__(self) -> Bytes:
        return self

    def __exit__(self, *_) -> None:
        pass


def expand(path: str) -> list[str]:
    """The files of a path: itself, those of a directory tree, or of a glob pattern (local), in order of their names."""
    system, inner = _split(path)
    if system is not None:
        from pyarrow import fs

        info = system.get_file_info(inner)
        if info.type != fs.FileType.Directory:
            return [path]
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else path.split(inner)[0]
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".dta"))
    if os.path.isdir(inner):
        return sorted(os.path.join(d, f) for d, _, names in os.walk(inner) for f in names if f.endswith(".dta"))
    if os.path.exists(inner):
        return [inner]
    found = sorted(glob.glob(inner, recursive=True))
    if not found:
        raise FileNotFoundError(path)
    return found
