"""Session helpers: shared storage, lineage cuts and shipping the package to Python workers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Prepare a session for Python workers: importable sources and small Arrow batches.

    The sources travel with ``addPyFile`` once per application, which Spark's own file server
    distributes. Batches are bounded in bytes below Spark's default, so long texts don't add up.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, "4m")
    if getattr(sc, "_lattica_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(), "lattica_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    sc._lattica_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or the
    checkpoint folder that the application has set itself.

    Only where neither is there (tests, a single machine) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    made = getattr(sc, "_lattica_shared", None)
    if made is None and sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir().rstrip("/")
    if made is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = sc._lattica_shared = "file://" + tempfile.mkdtemp(prefix="lattica-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(made)
    return made


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/lattica-{tag}-{uuid.uuid4().hex}"


def temporary(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, deleted when the application ends."""
    path = scratch(spark, tag)
    fs, where = _store(spark, path)
    fs.mkdirs(where)  # what isn't there can't be marked
    fs.deleteOnExit(where)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read again.

    The copy survives lost executors, unlike a cached or local checkpoint. It is deleted by
    ``dropped``, or else when the application ends.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    df.write.parquet(path)
    fs, where = _store(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    _open_scopes and _open_scopes[-1].append(out)
    return out


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def dropped(*frames: DataFrame) -> None:
    """Deletes what ``written`` has written for frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_lattica_path", None)
        if path is not None:
            fs, where = _store(df.sparkSession, path)
            fs.delete(where, True)


_open_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scope():
    """Deletes at its end what ``written`` has written inside."""
    _open_scopes.append([])
    try:
        yield
    finally:
        dropped(*_open_scopes.pop())


def settled(make, tag: str) -> DataFrame:
    """The DataFrame that make() returns, written; what was written on the way is deleted."""
    with scope():
        df = make()
        _open_scopes.append([])  # the result outlives the scope
        try:
            out = written(df, tag)
        finally:
            _open_scopes.pop()
    if _open_scopes:
        _open_scopes[-1].append(out)
    return out


_UNKNOWN = 1 << 52  # plans without statistics count as 2**63 bytes, less in proportion to the columns taken


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of a plan; it only sizes partition counts."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fan_out(df: DataFrame, bytes_each: int) -> int:
    """Shuffle partitions: the session's count, or more if the input is known to be larger."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return least if size >= _UNKNOWN else max(least, -(-size // bytes_each))
