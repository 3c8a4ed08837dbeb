"""Shared-storage file access for the few things Spark readers do not cover."""

from __future__ import annotations

from pyarrow import fs


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path inside it, for a URI or a plain local path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def exists(path: str) -> bool:
    system, inner = open_fs(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def is_complete(path: str) -> bool:
    """True when a Spark job finished writing the directory ``path``."""
    return exists(path.rstrip("/") + "/_SUCCESS")


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of one file, or of the visible files of a directory in path order."""
    system, inner = open_fs(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    found = system.get_file_info(fs.FileSelector(inner))
    visible = [f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    return [(prefix + f.path, f.size) for f in sorted(visible, key=lambda f: f.path)]
