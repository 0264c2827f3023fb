"""Version history from exported text: `git log` with names and states, and `git blame` in porcelain form.

The exports are plain files that any store holds; executors need no repository and no binary.
"""

from __future__ import annotations

import contextlib
import io
import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica import schemas as S
from lattica.session import ship

#: The format to export with: git log --name-status --format=LOG_FORMAT
LOG_FORMAT = "%x01%H%x02%an%x02%ae%x02%ct%x02%s"
STATES = {"A": "ADD", "M": "MODIFY", "D": "DELETE", "R": "RENAME", "C": "COPY"}


def parse_log(text: str) -> list[tuple]:
    """(sha, author, email, epoch, subject, kind, path) for each changed file; one row without path if none."""
    out = []
    for block in text.split("\x01")[1:]:
        head, _, rest = block.partition("\n")
        sha, author, email, epoch, subject = head.split("\x02", 4)
        changes = [line.split("\t") for line in rest.split("\n") if "\t" in line]
        for c in changes or [["", None]]:
            out.append((sha, author, email, int(epoch), subject, STATES.get(c[0][:1]), c[-1]))
    return out


def parse_blame(text: str) -> list[tuple]:
    """(line, author, email) for each line of a file; null for lines that aren't committed."""
    out, author, email = [], None, None
    for row in text.split("\n"):
        if row.startswith("author "):
            author = row[7:]
        elif row.startswith("author-mail "):
            email = row[12:].strip("<>")
        elif row.startswith("\t"):
            known = author not in (None, "Not Committed Yet")
            out.append((len(out) + 1, author if known else None, email if known else None))
    return out


BATCH = 10_000  # rows of an Arrow batch, or those of one text


def _parsed(files: DataFrame, f, names: list[str], types: list, ddl: str) -> DataFrame:
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), *types], strict=True)], ["key", *names])
        for b in batches:
            held: list[tuple] = []
            for key, raw in zip(b["key"].to_pylist(), b["content"].to_pylist(), strict=True):
                held += ((key, *row) for row in f((raw or b"").decode("utf-8", "replace")))
                if len(held) >= BATCH:  # small texts share a batch
                    yield made(held)
                    held = []
            if held:
                yield made(held)

    return files.mapInArrow(run, f"key string, {ddl}")


def log(files: DataFrame) -> DataFrame:
    """project, sha, author, email, committed_at, subject, kind, path; files: key (the project), content."""
    s, n = pa.string(), pa.int64()
    rows = _parsed(files, parse_log, ["sha", "author", "email", "epoch", "subject", "kind", "path"], [s, s, s, n, s, s, s], "sha string, author string, email string, epoch long, subject string, kind string, path string")
    return rows.select(F.col("key").alias("project"), "sha", "author", "email", F.timestamp_seconds("epoch").alias("committed_at"), "subject", "kind", "path")


def last_commits(rows: DataFrame, n: int) -> DataFrame:
    """The newest n commits of each project, newest first."""
    w = Window.partitionBy("project").orderBy(F.desc("committed_at"), "sha")
    every = rows.select("project", "sha", "author", "email", "committed_at", "subject").distinct()
    return every.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("n").orderBy("project", F.desc("committed_at"), "sha")


def commit_tree(archives: DataFrame) -> DataFrame:
    """sha, canonical_path, content of every file of exported commits, without the skipped top directories.

    archives: sha, content (what `git archive` writes, a tar file)."""
    ship(archives.sparkSession)
    tops = tuple(f"{d}/" for d in S.SKIPPED_DIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sha, raw in zip(b["sha"].to_pylist(), b["content"].to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(raw or b"")) if raw else contextlib.nullcontext(()) as entries:
                    for e in entries:
                        if e.isfile() and not e.name.lower().startswith(tops):
                            yield pa.RecordBatch.from_arrays([pa.array([sha]), pa.array([e.name]), pa.array([entries.extractfile(e).read()], pa.binary())], ["sha", "canonical_path", "content"])

    return archives.select("sha", "content").mapInArrow(run, "sha string, canonical_path string, content binary")


def blame(files: DataFrame) -> DataFrame:
    """path, line, author, email; files: key (the path), content."""
    rows = _parsed(files, parse_blame, ["line", "author", "email"], [pa.int32(), pa.string(), pa.string()], "line int, author string, email string")
    return rows.withColumnRenamed("key", "path")


def clone_depth_ok(text: str) -> bool:
    """Whether an address is one that shallow clones accept."""
    return re.fullmatch(r"(?i)https?://(www\.)?github\.com/[\w.-]+/[\w.-]+(\.git)?/?", text.strip()) is not None
