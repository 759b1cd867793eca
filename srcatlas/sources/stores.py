"""Folders and stores by address."""

from __future__ import annotations

import re

from pyarrow import fs


def local_path(root: str) -> str | None:
    """The path of a local root, with or without ``file:``; None for a store."""
    bare = re.sub(r"^file:/+", "/", root)
    return None if re.match(r"^[a-z][a-z0-9+.-]*:", bare) else bare.rstrip("/") or "/"


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root and the path in it."""
    local = local_path(root)
    if local is not None:
        return fs.LocalFileSystem(), local
    store, path = fs.FileSystem.from_uri(root)
    return store, path.rstrip("/")
