"""A data source that reads a code base without entering the directories that an analysis skips.

The tree is walked level by level: the directories of a level are listed side by side, those to be
skipped are dropped from what the listing names, and only the rest is descended into. So nothing
below a skipped directory is listed, let alone read. The files found are dealt into partitions of
bounded bytes and number, whatever directory they lie in.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import PurePosixPath
from typing import BinaryIO
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lattica import schemas as S

PART_BYTES, PART_FILES, BATCH_BYTES = 32 << 20, 2000, 4 << 20
LISTERS = 16  # directories listed at a time

#: A listing: names of directories, and names and sizes of files.
Listing = tuple[list[str], list[tuple[str, int]]]


def local_listing(path: str) -> Listing:
    """What a local directory holds; links to directories aren't followed."""
    dirs, files = [], []
    with os.scandir(path) as found:
        for x in found:
            if x.is_dir(follow_symlinks=False):
                dirs.append(x.name)
            elif x.is_file():
                files.append((x.name, x.stat().st_size))
    return dirs, files


class Store:
    """The few things asked of a file system; other than local ones by Arrow."""

    def __init__(self, root: str) -> None:
        parsed = urlparse(root)
        self.remote = None
        self.root = root.rstrip("/") or "/"
        if parsed.scheme == "file":
            self.root = unquote(parsed.path).rstrip("/") or "/"
        elif re.match("[a-zA-Z][a-zA-Z0-9+.-]*://", root):
            from pyarrow import fs

            self.remote, base = fs.FileSystem.from_uri(root)
            self.root = base.rstrip("/")

    def listing(self, below: str) -> Listing:
        path = f"{self.root}/{below}" if below else self.root
        if self.remote is None:
            return local_listing(path)
        from pyarrow import fs

        found = self.remote.get_file_info(fs.FileSelector(path, recursive=False))
        return [x.base_name for x in found if x.type == fs.FileType.Directory], [(x.base_name, x.size) for x in found if x.type == fs.FileType.File]

    def opened(self) -> BinaryIO:
        """The root itself as a file that can be read from any place."""
        return open(self.root, "rb") if self.remote is None else self.remote.open_input_file(self.root)

    def read(self, below: str) -> bytes:
        path = f"{self.root}/{below}"
        if self.remote is None:
            with open(path, "rb") as f:
                return f.read()
        with self.remote.open_input_stream(path) as f:
            return f.read()


def walk(listing: Callable[[str], Listing], skipped: frozenset[str], suffixes: frozenset[str], names: frozenset[str] = frozenset()) -> Iterator[tuple[str, int]]:
    """Paths below the root and sizes of the files with one of the suffixes or names, a level after the other."""
    level = [""]
    with ThreadPoolExecutor(LISTERS) as pool:
        while level:
            below = []
            for at, (dirs, files) in zip(level, pool.map(listing, level), strict=True):
                prefix = f"{at}/" if at else ""
                below += [prefix + d for d in dirs if d not in skipped]
                yield from ((prefix + name, size) for name, size in files if name in names or PurePosixPath(name).suffix.lower() in suffixes)
            level = sorted(below)


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: tuple[str, ...]


def dealt(files: Iterator[tuple[str, int]], most_bytes: int = PART_BYTES, most_files: int = PART_FILES) -> Iterator[Files]:
    """Files in groups that stay below both bounds, or single ones."""
    held, total = [], 0
    for path, size in files:
        if held and (total + size > most_bytes or len(held) >= most_files):
            yield Files(tuple(held))
            held, total = [], 0
        held.append(path)
        total += size
    if held:
        yield Files(tuple(held))


class _Reader(DataSourceReader):
    def __init__(self, root: str, skipped: frozenset[str], suffixes: frozenset[str], names: frozenset[str]) -> None:
        self.root, self.skipped, self.suffixes, self.names = root, skipped, suffixes, names

    def partitions(self) -> list[InputPartition]:
        found = list(dealt(walk(Store(self.root).listing, self.skipped, self.suffixes, self.names)))
        return found or [Files(())]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store = Store(self.root)
        paths: list[str] = []
        texts: list[str] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["canonical_path", "source"])

        for path in partition.paths:
            data = store.read(path)
            paths.append(path)
            texts.append(data.decode("utf-8", "replace"))
            size += len(data)
            if size >= BATCH_BYTES:
                yield batch()
                paths, texts, size = [], [], 0
        if paths:
            yield batch()


class CodeTree(DataSource):
    """Format `code_tree`: canonical_path and source of the files below `path`.

    Options, all by commas: skip (names of directories), suffixes (in lower case), or names of files
    instead of suffixes."""

    @classmethod
    def name(cls) -> str:
        return "code_tree"

    def schema(self) -> str:
        return S.FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        of = lambda name, default: frozenset(self.options[name].split(",")) if self.options.get(name) else frozenset(default)
        names = of("names", ())
        return _Reader(self.options["path"], of("skip", S.SKIPPED_DIRS), of("suffixes", () if names else S.SUFFIXES), names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CodeTree)
