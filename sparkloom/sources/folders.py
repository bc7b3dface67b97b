"""Folders of any file system that pyarrow knows, for readers and writers in tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it. Hadoop's short
    form ``file:/folder`` counts as local."""
    try:
        system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    except Exception as error:
        raise ValueError(f"no file system for {path!r}: {error}") from error
    return system, inner.rstrip("/")


def visible(path: str, root: str) -> bool:
    """Spark's rule: no part below ``root`` starts with ``_`` or ``.``."""
    return not re.search(r"(^|/)[_.]", path[len(root) :].lstrip("/"))


def files_below(system: fs.FileSystem, root: str, recursive: bool = True) -> Iterator[fs.FileInfo]:
    """Visible files of a folder, folder by folder, so that one folder is held."""
    waiting = [root]
    while waiting:
        for info in sorted(system.get_file_info(fs.FileSelector(waiting.pop())), key=lambda x: x.path):
            if not visible(info.path, root):
                continue
            if info.type == fs.FileType.File:
                yield info
            elif recursive and info.type == fs.FileType.Directory:
                waiting.append(info.path)
