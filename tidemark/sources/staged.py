"""Folders that tasks fill and that appear whole or not at all, on any store that pyarrow opens.

A task writes below a folder of its own attempt. When all tasks are done the driver moves the files of the
attempts that ended well to their place; when one fails everything that was written goes.
"""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path on it."""
    local = re.match(r"(?:file:/*(?=/)|(?![a-zA-Z][\w+.-]*:/))(.*)", path)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(path)


def listed(path: str) -> list[str]:
    """Files below ``path``, in order, relative to it; none if it is not there."""
    store, root = opened(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(f.path[len(root.rstrip("/")) + 1 :] for f in found if f.type == fs.FileType.File)


@dataclass
class Filled(WriterCommitMessage):
    """What a task leaves: its attempt's folder and how many files it holds."""

    folder: str
    files: int


class Attempt:
    """One task's files, below a folder of its own."""

    def __init__(self, staging: str):
        self.folder, self.files = f"{staging}/{uuid.uuid4().hex}", 0
        self.store, self.root = opened(self.folder)
        self.made: set[str] = set()

    def put(self, name: str, content: bytes) -> None:
        parent = f"{self.root}/{name}".rpartition("/")[0]
        if parent not in self.made:
            self.store.create_dir(parent, recursive=True)
            self.made.add(parent)
        with self.store.open_output_stream(f"{self.root}/{name}", compression=None) as out:
            out.write(content)
        self.files += 1

    def filled(self) -> Filled:
        return Filled(self.folder, self.files)


class Staged:
    """The target folder, as the driver sees it."""

    def __init__(self, path: str, replace: bool):
        self.path, self.replace = path.rstrip("/"), replace
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def commit(self, done: list[Filled]) -> None:
        """Moves the files of one attempt after the other; a name that is there already is replaced."""
        store, root = opened(self.path)
        if self.replace:
            store.delete_dir_contents(root, missing_dir_ok=True)
        store.create_dir(root, recursive=True)
        made: set[str] = set()
        with ThreadPoolExecutor(16) as pool:
            for task in done:
                if not task or not task.files:
                    continue
                names = listed(task.folder)
                for parent in {n.rpartition("/")[0] for n in names} - made - {""}:
                    store.create_dir(f"{root}/{parent}", recursive=True)
                    made.add(parent)
                folder = opened(task.folder)[1]
                list(pool.map(lambda n, f=folder: store.move(f"{f}/{n}", f"{root}/{n}"), names))
        self.abort()

    def abort(self) -> None:
        store, staging = opened(self.staging)
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)
