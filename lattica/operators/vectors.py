"""Vectors of files and clusters: embedding, centroids and nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import scalar as fn
from lattica.session import ship

BROADCAST_BYTES = 32 << 20  # of centroids, counted before they are broadcast
BLOCK = 2048  # vectors of a side that meet in one task beyond that
ROWS = 256  # of a block's vectors that are compared at once


def embedded(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """id, v: the vector that a model gives each text (null: empty); texts: id, text.

    The model is any function from texts to vectors, called with `batch` texts at a time."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                vectors = model([t or "" for t in part["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["id"], pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float64()))], ["id", "v"])

    return texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, v array<double>")


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """Element-wise mean of each group's vectors; one partially aggregated shuffle."""
    long = vectors.select(by, F.posexplode("v").alias("i", "x"))
    mean = long.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def _slices(n, size: int):
    return F.greatest(F.lit(1), F.ceil(n / size)).cast("int")


def _slice(key, slices):
    return F.pmod(F.xxhash64(key), slices).cast("int")


def nearest_centroid(vectors: DataFrame, centers: DataFrame, by: str, bound: int = BROADCAST_BYTES, block: int = BLOCK) -> DataFrame:
    """id, best, similarity: the centroid with the greatest cosine, ties to the smaller name.

    Centroids of up to `bound` bytes in all are broadcast. More are dealt into blocks, as are the
    vectors, and every block meets every other one; the best of a vector is aggregated."""
    c = centers.select(F.col(by).alias("best"), "centroid")
    size = c.agg(F.count("*").alias("n"), F.sum(F.size("centroid") * F.lit(8) + F.lit(64)).alias("bytes")).first()
    sim = fn.cosine(F.col("v"), F.col("centroid"))
    if (size["bytes"] or 0) <= bound:
        pairs = vectors.select("id", "v").crossJoin(F.broadcast(c))
    else:
        across, down = (F.lit(max(1, -(-n // block))) for n in (size["n"], vectors.count()))
        q = vectors.select("id", "v", _slice("id", down).alias("y"), F.explode(F.sequence(F.lit(0), across - 1)).alias("x"))
        pairs = q.join(c.select("best", "centroid", _slice("best", across).alias("x"), F.explode(F.sequence(F.lit(0), down - 1)).alias("y")), ["x", "y"])
    return pairs.withColumn("s", sim).groupBy("id").agg(F.min_by(F.struct("best", "s"), F.struct(-F.col("s"), F.col("best"))).alias("r")).select("id", "r.best", F.col("r.s").alias("similarity"))


def nearest_member(queries: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """id, best, similarity: the nearest other member of the same group, ties to the smaller id.

    Both: id, grp, v. An equi-join on the group and a pair of slices, so that a large group's pairs
    are dealt out; of each vector the best is aggregated."""
    asked = queries.groupBy("grp").agg(_slices(F.count("*"), block).alias("down"))
    held = members.groupBy("grp").agg(_slices(F.count("*"), block).alias("across"))
    sizes = asked.join(held, "grp")
    q = queries.join(sizes, "grp").select("grp", "id", "v", _slice("id", F.col("down")).alias("y"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("x"))
    m = members.join(sizes, "grp").select("grp", F.col("id").alias("best"), F.col("v").alias("w"), _slice("id", F.col("across")).alias("x"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("y"))
    ship(queries.sparkSession)
    schema = f"id {queries.schema['id'].dataType.simpleString()}, best {members.schema['id'].dataType.simpleString()}, s double"
    q = q.where("id is not null").toDF("grp", "id", "v", "y", "x").groupBy("grp", "x", "y")  # names of their own, so a table may meet itself
    m = m.where("best is not null").toDF("group", "best", "w", "column", "row").groupBy("group", "column", "row")
    pairs = q.cogroup(m).applyInArrow(_best_of_block, schema)
    return pairs.groupBy("id").agg(F.min_by(F.struct("best", "s"), F.struct(-F.col("s"), F.col("best"))).alias("r")).select("id", "r.best", F.col("r.s").alias("similarity"))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component on, as `fn.dot` does."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total = total + a[:, i] * b[:, i]
    return total


def _cosine(a: list | None, b: list | None) -> float | None:
    """`fn.cosine` of two vectors of any kind: null, with nulls or of different lengths."""
    if a is None or b is None or None in a or None in b:
        return 0.0
    with np.errstate(all="ignore"):
        square = [float(_dots(np.array([x], "f8"), np.array([x], "f8"))[0]) for x in (a, b)]
        n = math.sqrt(square[0]) * math.sqrt(square[1])
        if n == 0:
            return 0.0
        return None if len(a) != len(b) else float(_dots(np.array([a], "f8"), np.array([b], "f8"))[0] / np.float64(n))


def _rank(s: float | None) -> tuple:
    return (0, 0.0) if s is None else (2, 0.0) if math.isnan(s) else (1, -s)


def _plain(vectors: list, dims: int | None) -> tuple[np.ndarray, np.ndarray, int | None]:
    """Which vectors are numbers of a usual size and as many as dims (None: as the first such one has), and the matrix of these."""
    kept, rows = [], []
    for i, v in enumerate(vectors):
        if v and None not in v and (dims is None or len(v) == dims) and 1e-100 < math.hypot(*v) < 1e100:
            dims = len(v)
            kept.append(i)
            rows.append(v)
    return np.array(kept, "i8"), np.array(rows, "f8").reshape(len(rows), dims or 0), dims


def _best_of_block(left: pa.Table, right: pa.Table) -> pa.Table:
    """id, best, s: of each vector on the left (id, v) the nearest one of another name on the right (best, w), if any.

    A matrix product finds those that may be nearest up to its rounding, and these are compared exactly."""
    right = right.sort_by("best")  # so the first of equals is that with the smallest name
    ids, names, v, w = left["id"].to_pylist(), right["best"].to_pylist(), left["v"].to_pylist(), right["w"].to_pylist()
    places: dict = {}
    for j, name in enumerate(names):
        places.setdefault(name, []).append(j)
    at, a, dims = _plain(v, None)
    held, b, _ = _plain(w, dims)
    column = np.full(len(names), -1)
    column[held] = np.arange(len(held))
    na, nb = np.sqrt(_dots(a, a)), np.sqrt(_dots(b, b))
    found: dict[int, tuple[float | None, int]] = {}
    for lo in range(0, len(at) if len(held) else 0, ROWS):
        x, nx = a[lo : lo + ROWS], na[lo : lo + ROWS]
        near = (x / nx[:, None]) @ (b / nb[:, None]).T
        for r, i in enumerate(at[lo : lo + ROWS]):
            near[r, [column[j] for j in places.get(ids[i], ()) if column[j] >= 0]] = -np.inf
        most = near.max(axis=1, keepdims=True)
        r, c = np.nonzero((near >= most - 1e-9) & (near > -np.inf))
        exact = _dots(x[r], b[c]) / (nx[r] * nb[c])
        for k in np.lexsort((c, -exact, r))[::-1]:  # the best of a row comes last
            found[int(at[lo + r[k]])] = (float(exact[k]), int(held[c[k]]))
    usual, odd = {*at.tolist()}, [j for j in range(len(names)) if column[j] < 0]
    for i in range(len(ids)):
        for j in odd if i in usual else range(len(names)):
            if names[j] != ids[i]:
                s = _cosine(v[i], w[j])
                if i not in found or (_rank(s), j) < (_rank(found[i][0]), found[i][1]):
                    found[i] = (s, j)
    rows = sorted(found)
    best = pa.array([found[i][1] for i in rows], pa.int64())
    return pa.table({"id": left["id"].take(pa.array(rows, pa.int64())), "best": right["best"].take(best), "s": pa.array([found[i][0] for i in rows], pa.float64())})
