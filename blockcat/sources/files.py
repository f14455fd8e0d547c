"""A file scan as a Python data source: every entry below the given roots, hidden ones too.

The built-in file sources leave out names that begin with a dot or an underscore, which a scan for such files can't
use. The scan only reads: junk is flagged, never deleted. Each child of a root is a partition of its own, so wide trees
are walked in parallel. Paths must be visible to all executors (a mounted file system).
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from blockcat.functions.scalars import JUNK_NAMES

SCHEMA = "root string, rel string, abs string, name string, size long, blocks long, mtime long, is_dir boolean, junk boolean"


class Branch(InputPartition):
    def __init__(self, root: str, start: str, deep: bool):
        self.root, self.start, self.deep = root, start, deep


class FilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = [r.rstrip("/") or "/" for r in options["path"].split(",") if r]
        self.strict = options.get("strict", "false").lower() == "true"

    def partitions(self) -> list[Branch]:
        out = []
        for root in self.roots:
            with os.scandir(root) as entries:
                out += [Branch(root, e.path, e.is_dir(follow_symlinks=False)) for e in sorted(entries, key=lambda e: e.name)]
        return out or [Branch(r, r, False) for r in self.roots[:1]]

    def read(self, branch: Branch) -> Iterator[tuple]:
        if branch.start == branch.root:
            return
        waiting = [branch.start]
        while waiting:
            path = waiting.pop()
            info = os.lstat(path)
            rel, name = os.path.relpath(path, branch.root), os.path.basename(path)
            folder = stat.S_ISDIR(info.st_mode)
            if not folder and not stat.S_ISREG(info.st_mode):
                if self.strict:
                    raise ValueError(f"neither a file nor a folder: {path}")
                continue
            if self.strict and not all(0x20 <= ord(c) <= 0x7E for c in rel):
                raise ValueError(f"not printable ASCII: {rel!r}")
            yield branch.root, rel, path, name, 0 if folder else info.st_size, info.st_blocks, int(info.st_mtime), folder, name in JUNK_NAMES or name.startswith("._")
            if folder:
                with os.scandir(path) as entries:
                    waiting += [e.path for e in entries]


class Files(DataSource):
    """``spark.read.format("blockcat_files").option("path", "/a,/b").load()``"""

    @classmethod
    def name(cls) -> str:
        return "blockcat_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)
