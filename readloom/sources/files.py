"""Input files: one path, several, or named ones; local paths, or addresses of a file system that pyarrow opens (file, hdfs, s3, gs)."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyarrow import NativeFile, fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def open_input(path: str) -> NativeFile:
    """A file opened for reading anywhere in it."""
    system, at = located(path)
    return system.open_input_file(at)


def named_paths(files: str | os.PathLike | Iterable | Mapping) -> list[tuple[str, str]]:
    """(name, path) of each file. Names are the caller's or else base names, which may collide. None given, or one that does not exist, is an error."""
    if isinstance(files, (str, os.PathLike)):
        files = [files]
    pairs = [(str(n), os.fspath(p)) for n, p in files.items()] if isinstance(files, Mapping) else [(os.path.basename(os.fspath(p)), os.fspath(p)) for p in files]
    if not pairs:
        raise ValueError("no input file")
    if missing := [p for _, p in pairs if not (lambda x: x[0].get_file_info(x[1]).is_file)(located(p))]:
        raise FileNotFoundError(f"no such file: {missing}")
    return pairs
