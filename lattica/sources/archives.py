"""Archives read by range: the directory first, then every entry's own bytes in some task.

Of a zip archive the central directory is read, of a tar archive the headers, skipping what lies
between. Entries are dealt into partitions by their bytes, so one large archive is read by many
tasks, each of which takes only its entries' ranges and holds the largest of them at most. Compressed
tar archives have no ranges; they are read whole (`git.commit_tree`).
"""

from __future__ import annotations

import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lattica import schemas as S
from lattica.session import ship
from lattica.sources.tree import BATCH_BYTES, LISTERS, PART_BYTES, Store

_LOCAL_HEADER = 30  # bytes of a zip entry's own header before its name


class Entry(NamedTuple):
    """A file inside an archive: where its bytes are and how they are packed."""

    archive: str
    name: str
    offset: int
    packed: int
    size: int
    method: int


def kept_in_zip(name: str) -> bool:
    """Whether an upload's entry is a file inside its root and outside the skipped directories."""
    parts = name.split("/")
    return not name.endswith("/") and ".." not in parts and not name.startswith("/") and not set(parts) & set(S.SKIPPED_IN_ZIP)


def kept_in_tar(name: str) -> bool:
    """Whether an exported commit's file is outside the skipped top directories."""
    return not name.lower().startswith(tuple(f"{d}/" for d in S.SKIPPED_DIRS))


def zip_directory(archive: str, f: BinaryIO) -> Iterator[Entry]:
    with zipfile.ZipFile(f) as z:
        for x in z.infolist():
            name = x.filename.replace("\\", "/")
            if kept_in_zip(name):
                if x.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or x.flag_bits & 1:
                    raise ValueError(f"{archive}: {name} is encrypted or packed by another method than deflate")
                yield Entry(archive, name, x.header_offset, x.compress_size, x.file_size, x.compress_type)


def tar_directory(archive: str, f: BinaryIO) -> Iterator[Entry]:
    with tarfile.open(fileobj=f, mode="r:") as t:
        for x in t:
            if x.isfile() and kept_in_tar(x.name):
                yield Entry(archive, x.name, x.offset_data, x.size, x.size, -1)


def content(f: BinaryIO, e: Entry) -> bytes:
    """An entry's bytes, read from its own range."""
    f.seek(e.offset)
    if e.method < 0:
        return f.read(e.size)
    head = f.read(_LOCAL_HEADER)
    names = sum(struct.unpack_from("<HH", head, 26))
    f.seek(e.offset + _LOCAL_HEADER + names)
    raw = f.read(e.packed)
    return raw if e.method == zipfile.ZIP_STORED else zlib.decompress(raw, -15)


@dataclass
class Entries(InputPartition):
    """Entries that one task reads."""

    entries: tuple[Entry, ...]


def dealt(entries: Iterator[Entry], most: int = PART_BYTES) -> Iterator[Entries]:
    """Entries in the order of their places, in groups of bounded bytes, or single ones."""
    held: list[Entry] = []
    total = 0
    for e in entries:
        cost = e.size + 4096
        if held and total + cost > most:
            yield Entries(tuple(held))
            held, total = [], 0
        held.append(e)
        total += cost
    if held:
        yield Entries(tuple(held))


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], most: int) -> None:
        self.paths, self.most = paths, most

    def _listed(self, path: str) -> list[Entry]:
        directory: Callable = tar_directory if path.lower().endswith(".tar") else zip_directory
        with Store(path).opened() as f:
            return sorted(directory(path, f), key=lambda e: e.offset)

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(LISTERS) as pool:
            found = [p for entries in pool.map(self._listed, self.paths) for p in dealt(iter(entries), self.most)]
        return found or [Entries(())]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, bytes]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            a, n, c = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), pa.array(c, pa.binary())], ["archive", "canonical_path", "content"])

        at, f = None, None
        try:
            for e in partition.entries:
                if e.archive != at:
                    if f is not None:
                        f.close()
                    at, f = e.archive, Store(e.archive).opened()
                held.append((e.archive, e.name, content(f, e)))
                size += e.size
                if size >= BATCH_BYTES:
                    yield batch()
                    held, size = [], 0
            if held:
                yield batch()
        finally:
            if f is not None:
                f.close()


class ArchiveEntries(DataSource):
    """Format `archive_entries`: archive, canonical_path and content of the files inside archives.

    Options: paths (a JSON list of .zip and .tar files) and bytes (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "archive_entries"

    def schema(self) -> str:
        return "archive string, canonical_path string, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        import json

        return _Reader(json.loads(self.options["paths"]), int(self.options.get("bytes", PART_BYTES)))


def entries(spark: SparkSession, paths: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """archive, canonical_path, content of the files inside zip and tar archives, read by range.

    Skipped directories and escaping names are left out as uploads and exported commits leave them out."""
    import json

    ship(spark)
    spark.dataSource.register(ArchiveEntries)
    return spark.read.format("archive_entries").option("paths", json.dumps(paths)).option("bytes", str(part_bytes)).load()
