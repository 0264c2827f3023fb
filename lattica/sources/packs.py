"""A repository's history from its own files: packs and loose objects as rows, trees walked by joins.

Format `git_objects` gives every object once: its name, kind and content. A pack's index says where
its objects begin; ranges of them are partitions, and a task reads its range and the delta bases that
the range's objects lean on, with a bounded cache. No binary is needed. Commits, the files of a
commit and the changes between commits are DataFrames from there on: trees are walked level by level
for all commits at once, and two trees that are equal are never entered.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lattica import schemas as S
from lattica.session import settled, ship, written

KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}  # fixed values of the pack format
_OFS_DELTA, _REF_DELTA = 6, 7
PART_BYTES, BATCH_BYTES, CACHE_BYTES = 16 << 20, 4 << 20, 64 << 20
LOOSE_A_PART = 2000


class Pack:
    """One pack and its index (version 2)."""

    def __init__(self, path: str) -> None:
        self.path = path
        raw = np.fromfile(path.removesuffix(".pack") + ".idx", dtype=np.uint8)
        if raw[:8].tobytes() != b"\xfftOc\x00\x00\x00\x02":
            raise ValueError(f"{path}: no index of version 2")
        n = int.from_bytes(raw[8 + 255 * 4 : 8 + 256 * 4].tobytes(), "big")
        at = 8 + 256 * 4
        self.names = raw[at : at + 20 * n].reshape(n, 20)
        small = raw[at + 24 * n : at + 28 * n].view(">u4").astype(np.int64)
        large = raw[at + 28 * n : len(raw) - 40].view(">u8").astype(np.int64)
        far = small >= 1 << 31
        self.offsets = np.where(far, large[np.where(far, small - (1 << 31), 0)] if len(large) else 0, small)
        self.order = np.argsort(self.offsets, kind="stable")  # objects as they lie in the pack

    def named(self, name: bytes) -> int | None:
        """The place of an object, by binary search in the sorted names."""
        lo, hi = 0, len(self.names)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.names[mid].tobytes() < name:
                lo = mid + 1
            else:
                hi = mid
        return int(self.offsets[lo]) if lo < len(self.names) and self.names[lo].tobytes() == name else None


def _inflated(f: BinaryIO) -> bytes:
    d, out = zlib.decompressobj(), []
    while not d.eof:
        chunk = f.read(1 << 14)
        if not chunk:
            raise ValueError("an object ends too early")
        out.append(d.decompress(chunk))
    return b"".join(out)


def _applied(base: bytes, delta: bytes) -> bytes:
    """An object made from its base: ranges of it are copied, and new bytes stand between."""
    at = 0

    def size() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = delta[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    if size() != len(base):
        raise ValueError("a delta has another base")
    whole, out = size(), []
    while at < len(delta):
        op = delta[at]
        at += 1
        if op < 128:
            out.append(delta[at : at + op])
            at += op
            continue
        fields = [0] * 7
        for i in range(7):
            if op >> i & 1:
                fields[i] = delta[at]
                at += 1
        begin = int.from_bytes(bytes(fields[:4]), "little")
        n = int.from_bytes(bytes(fields[4:]), "little") or 0x10000
        out.append(base[begin : begin + n])
    made = b"".join(out)
    if len(made) != whole:
        raise ValueError("a delta gives another length")
    return made


class Objects:
    """Random access to the objects of a repository, with the last ones kept up to a number of bytes."""

    def __init__(self, root: str) -> None:
        self.root = root
        folder = f"{root}/objects/pack"
        self.packs = [Pack(f"{folder}/{n}") for n in sorted(os.listdir(folder)) if n.endswith(".pack")] if os.path.isdir(folder) else []
        self.files: dict[str, BinaryIO] = {}
        self.kept: OrderedDict[tuple[str, int], tuple[int, bytes]] = OrderedDict()
        self.bytes = 0

    def close(self) -> None:
        for f in self.files.values():
            f.close()

    def loose(self, name: str) -> tuple[str, bytes]:
        with open(f"{self.root}/objects/{name[:2]}/{name[2:]}", "rb") as f:
            head, _, body = zlib.decompress(f.read()).partition(b"\0")
        return head.split(b" ")[0].decode(), body

    def _keep(self, key: tuple[str, int], found: tuple[int, bytes]) -> None:
        self.kept[key] = found
        self.bytes += len(found[1])
        while self.bytes > CACHE_BYTES and len(self.kept) > 1:
            self.bytes -= len(self.kept.popitem(last=False)[1][1])

    def at(self, pack: Pack, offset: int) -> tuple[int, bytes]:
        """Kind and content of the object at a place: its chain of deltas down to a whole object, then up again."""
        chain: list[tuple[int, bytes]] = []
        while True:
            if (known := self.kept.get((pack.path, offset))) is not None:
                self.kept.move_to_end((pack.path, offset))
                kind, data = known
                break
            if pack.path not in self.files:
                self.files[pack.path] = open(pack.path, "rb")
            f = self.files[pack.path]
            f.seek(offset)
            b = f.read(1)[0]
            kind = b >> 4 & 7
            while b & 128:  # the size, which the content tells, too
                b = f.read(1)[0]
            if kind == _OFS_DELTA:
                b = f.read(1)[0]
                back = b & 127
                while b & 128:
                    b = f.read(1)[0]
                    back = (back + 1) << 7 | b & 127
                chain.append((offset, _inflated(f)))
                offset -= back
            elif kind == _REF_DELTA:
                name = f.read(20)
                chain.append((offset, _inflated(f)))
                inside = pack.named(name)
                if inside is None:
                    text, data = self.named(name.hex())
                    kind = next(k for k, v in KINDS.items() if v == text)
                    break
                offset = inside
            else:
                data = _inflated(f)
                self._keep((pack.path, offset), (kind, data))
                break
        for place, delta in reversed(chain):
            data = _applied(data, delta)
            self._keep((pack.path, place), (kind, data))
        return kind, data

    def named(self, name: str) -> tuple[str, bytes]:
        raw = bytes.fromhex(name)
        for p in self.packs:
            if (place := p.named(raw)) is not None:
                kind, data = self.at(p, place)
                return KINDS[kind], data
        return self.loose(name)


@dataclass
class Range(InputPartition):
    """Objects of a pack by their order in it, or loose ones by name."""

    pack: int
    begin: int
    end: int
    names: tuple[str, ...] = ()


class _Reader(DataSourceReader):
    def __init__(self, root: str, most: int) -> None:
        self.root, self.most = root, most

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        objects = Objects(self.root)
        for k, p in enumerate(objects.packs):
            places = p.offsets[p.order]
            cut = np.flatnonzero(np.diff(places // self.most, prepend=-1)) if len(places) else []
            out += [Range(k, int(a), int(z)) for a, z in zip(cut, [*cut[1:], len(places)], strict=True)]
        packed = {n.tobytes().hex() for p in objects.packs for n in p.names}
        folders = [d for d in os.listdir(f"{self.root}/objects") if re.fullmatch("[0-9a-f]{2}", d)]
        loose = sorted(n for d in folders for x in os.listdir(f"{self.root}/objects/{d}") if re.fullmatch("[0-9a-f]{38}", x) and (n := d + x) not in packed)
        out += [Range(-1, 0, 0, tuple(loose[i : i + LOOSE_A_PART])) for i in range(0, len(loose), LOOSE_A_PART)]
        return out or [Range(-1, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        objects = Objects(self.root)

        def found() -> Iterator[tuple[str, str, bytes]]:
            for name in partition.names:
                yield (name, *objects.loose(name))
            if partition.pack >= 0:
                p = objects.packs[partition.pack]
                for i in p.order[partition.begin : partition.end].tolist():
                    kind, data = objects.at(p, int(p.offsets[i]))
                    yield p.names[i].tobytes().hex(), KINDS[kind], data

        held: list[tuple[str, str, bytes]] = []
        size = 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], ["sha", "kind", "content"])
        for row in found():
            held.append(row)
            size += len(row[2]) + 64
            if size > BATCH_BYTES:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()
        objects.close()


class GitObjects(DataSource):
    """Format `git_objects`: sha, kind and content of every object of the repository at `path` (a .git folder that all tasks see)."""

    @classmethod
    def name(cls) -> str:
        return "git_objects"

    def schema(self) -> str:
        return "sha string, kind string, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"].removeprefix("file://").rstrip("/"), int(self.options.get("bytes", PART_BYTES)))


def objects(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """sha, kind, content of all objects; one that stands in several packs comes from each."""
    ship(spark)
    spark.dataSource.register(GitObjects)
    return spark.read.format("git_objects").option("bytes", str(part_bytes)).load(path)


def commits(objects_: DataFrame) -> DataFrame:
    """sha, tree, parents, author, email, committed_at, subject of every commit."""
    text = F.decode("content", "UTF-8")
    one = lambda pattern: F.regexp_extract(text, pattern, 1)
    head = F.regexp_extract(text, r"(?s)^(.*?)\n\n", 1)
    body = F.regexp_extract(text, r"(?s)^.*?\n\n\n*(.*)$", 1)
    parents = F.transform(F.filter(F.split(head, "\n"), lambda x: x.startswith("parent ")), lambda x: F.substring(x, 8, 40))
    subject = F.array_join(F.transform(F.split(F.get(F.split(body, r"\n[ \t]*\n"), F.lit(0)), "\n"), lambda x: F.trim(x)), " ")
    subject = F.trim(subject)
    at = F.timestamp_seconds(one(r"(?m)^committer .*> (\d+) [+-]\d{4}$").cast("long"))
    who = one(r"(?m)^author (.*?) ?<[^>]*> \d+ [+-]\d{4}$"), one(r"(?m)^author [^\n]*?<([^>]*)> \d+ [+-]\d{4}$")
    found = objects_.where("kind = 'commit'").dropDuplicates(["sha"])
    return found.select("sha", one(r"^tree ([0-9a-f]{40})").alias("tree"), parents.alias("parents"), who[0].alias("author"), who[1].alias("email"), at.alias("committed_at"), subject.alias("subject"))


def tree_entries(objects_: DataFrame) -> DataFrame:
    """tree, name, is_dir, mode, sha of what every tree holds; links to other repositories are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for tree, data in zip(b["sha"].to_pylist(), b["content"].to_pylist(), strict=True):
                at = 0
                while at < len(data):
                    zero = data.index(b"\0", at)
                    mode, name = data[at:zero].split(b" ", 1)
                    at = zero + 21
                    if mode != b"160000":
                        rows.append((tree, name.decode("utf-8", "replace"), mode == b"40000", mode.decode(), data[zero + 1 : at].hex()))
            if rows:
                kinds = (pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["tree", "name", "is_dir", "mode", "sha"])

    trees = objects_.where("kind = 'tree'").dropDuplicates(["sha"]).select("sha", "content")
    return trees.mapInArrow(run, "tree string, name string, is_dir boolean, mode string, sha string")


def tree_changes(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """id, path, kind (ADD, MODIFY, DELETE), blob, old_blob of the files in which two trees differ.

    pairs: id, new_tree, old_tree (null: no tree). A round goes one level down for all pairs, and only
    into directories that differ."""

    def make() -> DataFrame:
        at = written(pairs.select("id", F.lit("").alias("prefix"), F.col("new_tree").alias("new"), F.col("old_tree").alias("old")).where("not new <=> old"), "trees")
        known, out = written(entries, "entries"), []
        side = lambda c, n: at.where(F.col(c).isNotNull()).join(known, F.col(c) == F.col("tree")).select("id", "prefix", "name", F.struct("is_dir", "mode", "sha").alias(n))
        while not at.isEmpty():
            both = side("new", "n").join(side("old", "o"), ["id", "prefix", "name"], "full_outer").where("not n <=> o")
            both = written(both.withColumn("path", F.concat("prefix", "name")), "differ")
            new, old = F.when(~F.col("n.is_dir"), F.col("n.sha")), F.when(~F.col("o.is_dir"), F.col("o.sha"))
            kind = F.when(old.isNull(), "ADD").when(new.isNull(), "DELETE").otherwise("MODIFY")
            out.append(both.where(new.isNotNull() | old.isNotNull()).select("id", "path", kind.alias("kind"), new.alias("blob"), old.alias("old_blob")))
            below = both.select("id", F.concat("path", F.lit("/")).alias("prefix"), F.when(F.col("n.is_dir"), F.col("n.sha")).alias("new"), F.when(F.col("o.is_dir"), F.col("o.sha")).alias("old"))
            at = written(below.where("not new <=> old"), "trees")
        found = pairs.select("id", F.lit("").alias("path"), F.lit("").alias("kind"), F.lit("").alias("blob"), F.lit("").alias("old_blob")).where("false")
        for x in out:
            found = found.unionByName(x)
        return found

    return settled(make, "changes")


def renamed(changes: DataFrame) -> DataFrame:
    """changes with a file that went from one path to another unchanged as one RENAME (of the new path).

    Of several files with the same content the first by path go together."""
    w = Window.partitionBy("id", "same", "kind").orderBy("path")
    moved = changes.where("kind in ('ADD', 'DELETE')").withColumn("same", F.coalesce("blob", "old_blob")).withColumn("n", F.row_number().over(w))
    pair = moved.where("kind = 'ADD'").select("id", "same", "n", F.col("path").alias("to")).join(moved.where("kind = 'DELETE'").select("id", "same", "n", F.col("path").alias("from")), ["id", "same", "n"])
    pair = written(pair.select("id", "to", "from"), "renames")
    rest = changes.join(pair.select("id", F.col("from").alias("path"), F.lit("DELETE").alias("kind")), ["id", "path", "kind"], "left_anti")
    j = rest.join(pair.select("id", F.col("to").alias("path"), "from"), ["id", "path"], "left")
    return j.select("id", "path", F.when(F.col("from").isNotNull() & (F.col("kind") == "ADD"), "RENAME").otherwise(F.col("kind")).alias("kind"), "blob", F.coalesce("from", "path").alias("old_path"))


def log(objects_: DataFrame, project: str) -> DataFrame:
    """project, sha, author, email, committed_at, subject, kind, path: every commit's changes against its first
    parent, as `git.log` gives them from exported text; a row without path for a commit that changes nothing."""
    every = written(commits(objects_), "commits")
    first = every.select(F.col("sha").alias("id"), F.col("tree").alias("new_tree"), F.get("parents", F.lit(0)).alias("parent"))
    pairs = first.join(every.select(F.col("sha").alias("parent"), F.col("tree").alias("old_tree")), "parent", "left").select("id", "new_tree", "old_tree")
    changes = renamed(tree_changes(pairs, tree_entries(objects_))).select(F.col("id").alias("sha"), "kind", "path")
    return every.join(changes, "sha", "left").select(F.lit(project).alias("project"), "sha", "author", "email", "committed_at", "subject", "kind", "path")


def commit_files(objects_: DataFrame, shas: DataFrame) -> DataFrame:
    """sha, canonical_path, content of the files of some commits (sha), without the skipped top directories."""
    asked = commits(objects_).join(shas.select("sha").distinct(), "sha", "left_semi")
    tops = [f"{d}/" for d in S.SKIPPED_DIRS]
    skipped = F.lit(False)
    for t in tops:
        skipped = skipped | F.lower("path").startswith(t)
    files = tree_changes(asked.select(F.col("sha").alias("id"), F.col("tree").alias("new_tree"), F.lit(None).cast("string").alias("old_tree")), tree_entries(objects_).where("mode <> '120000'")).where(~skipped)
    blobs = objects_.where("kind = 'blob'").select(F.col("sha").alias("blob"), "content").join(files.select("blob").distinct(), "blob", "left_semi").dropDuplicates(["blob"])
    return files.select(F.col("id").alias("sha"), F.col("path").alias("canonical_path"), "blob").join(blobs, "blob").select("sha", "canonical_path", "content")
