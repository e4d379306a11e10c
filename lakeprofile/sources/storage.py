"""File-system access inside tasks. Nothing here runs on the driver."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyarrow import fs as arrow_fs


class Storage:
    """Opens paths of any scheme; keeps one connection per scheme and host for the life of a task."""

    # Hadoop scheme names and the names Arrow knows them by (fixed values).
    ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}

    def __init__(self):
        self._connections = {}

    def locate(self, path: str):
        """(file system, path inside it) of a local path or URI."""
        if path.startswith("file:"):
            path = "/" + path[len("file:"):].lstrip("/")
        if "://" not in path:
            if "" not in self._connections:
                self._connections[""] = arrow_fs.LocalFileSystem()
            return self._connections[""], path
        parts = urlsplit(path)
        scheme = self.ARROW_SCHEMES.get(parts.scheme, parts.scheme)
        key = (scheme, parts.netloc)
        rest = path.split("://", 1)[1]
        if key not in self._connections:
            file_system, base = arrow_fs.FileSystem.from_uri(f"{scheme}://{parts.netloc}/")
            self._connections[key] = (file_system, base.strip("/"))
        file_system, base = self._connections[key]
        inner = rest[len(parts.netloc):].lstrip("/")
        return file_system, f"{base}/{inner}".rstrip("/") if base else "/" + inner

    def info(self, path: str):
        file_system, inner = self.locate(path)
        return file_system.get_file_info(inner)

    def is_folder(self, path: str) -> bool:
        return self.info(path).type == arrow_fs.FileType.Directory

    def children(self, path: str) -> Iterator[tuple[str, bool, int | None, float | None]]:
        """(name, is folder, size, modified) of one level of a folder; local folders are streamed."""
        file_system, inner = self.locate(path)
        if isinstance(file_system, arrow_fs.LocalFileSystem):
            with os.scandir(inner) as entries:
                for entry in entries:
                    # A link to a folder may lead back up; what it shows is listed where it stands.
                    if entry.is_dir(follow_symlinks=False):
                        yield entry.name, True, None, None
                    elif entry.is_file():
                        status = entry.stat()
                        yield entry.name, False, status.st_size, status.st_mtime
            return
        for item in file_system.get_file_info(arrow_fs.FileSelector(inner, recursive=False)):
            folder = item.type == arrow_fs.FileType.Directory
            if folder or item.type == arrow_fs.FileType.File:
                modified = item.mtime_ns / 1e9 if item.mtime_ns is not None else None
                yield item.base_name, folder, None if folder else item.size, modified

    def open(self, path: str):
        file_system, inner = self.locate(path)
        return file_system.open_input_file(inner)

    def read_head(self, path: str, limit: int) -> bytes:
        with self.open(path) as handle:
            return handle.read(limit)


def join_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"
