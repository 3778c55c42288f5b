"""Binary files in the shared folder, from tasks: any place that pyarrow's file systems reach."""

from __future__ import annotations

import re

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path. file:/x is taken as file:///x."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def make_dir(path: str) -> None:
    system, name = place(path)
    system.create_dir(name, recursive=True)


def list_files(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """Path (as given, joined) and size of each file in a folder, by name."""
    system, name = place(path)
    found = system.get_file_info(fs.FileSelector(name))
    return sorted(
        (f"{path.rstrip('/')}/{x.base_name}", x.size)
        for x in found
        if x.type == fs.FileType.File and x.base_name.endswith(suffix)
    )
