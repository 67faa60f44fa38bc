"""Files by path or URI, opened on executors and the driver alike: whatever Arrow's file systems reach.

A path without a scheme is one of the local file system, which then has to be shared; ``file:``,
``hdfs://``, ``s3://`` and ``gs://`` are opened by their own.
"""

from __future__ import annotations

import os
import re

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]*://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def size(path: str) -> int | None:
    """Bytes of a file; None if there is none."""
    system, at = located(path)
    info = system.get_file_info(at)
    return info.size if info.type == fs.FileType.File else None


def opened(path: str):
    """The file for random access."""
    system, at = located(path)
    return system.open_input_file(at)


def listed(path: str, suffix: str) -> list[str]:
    """The path itself, or the files of a folder with a suffix, in order of name."""
    system, at = located(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File and i.base_name.endswith(suffix))
    return [f"{path.rstrip('/')}/{n}" for n in names]
