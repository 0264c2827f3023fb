"""Exact top-k search by exhaustive term-at-a-time accumulation.

Components are read as terms: a block of candidates is an inverted file with a posting list of
(row, weight) for each component that isn't zero. A query's nonzero components scatter their
weighted postings into a dense array of scores, one for each candidate of the block; partition
selection keeps the block's k best, and the blocks' lists are merged by query.

Queries and candidates are dealt by hash into blocks of bounded size, and every pair of a query
block and a candidate block is one task (a grid), so neither side is gathered or broadcast.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do
rows without vec_id; rows that repeat a vec_id are candidates each, and one query with the vector
that is greatest in array order; a query's own candidates (all rows of its vec_id) are left out; vectors may differ in length (missing
components are zero), and the longer they are the smaller are the blocks; components so large that an
inner product could exceed 64 bits raise ValueError before anything is scored; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.session import ship, written

K = 20
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 16384
BLOCK_CELLS = 1 << 24  # components of a candidate block: longer vectors make smaller blocks


def whole(vector: str, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as a 64-bit integer; null for unusable vectors."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(usable, F.transform(x, lambda v: F.floor(v * scale)))


def _postings(rows: list) -> tuple[list, int]:
    """For each component: the rows where it isn't zero, and their weights; None for all rows."""
    lens = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    dims = int(lens.max(initial=0))
    m = np.zeros((dims, len(rows)), dtype=np.int64)
    flat = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]) if lens.sum() else np.zeros(0, dtype=np.int64)
    at = np.repeat(np.arange(len(rows)), lens)
    m[np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens), at] = flat
    out = []
    for t in range(dims):
        where = np.flatnonzero(m[t])
        out.append((None, m[t]) if 2 * len(where) > len(rows) else (where, m[t][where]))
    return out, dims


def _cell(k: int):
    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        ids = c["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")  # ties go to the smaller vec_id
        ids = ids[order]
        lists, dims = _postings([x for x in c["v"].take(pa.array(order)).to_pylist()])
        out: list[tuple[np.ndarray, ...]] = []
        for query, vector in zip(q["vec_id"].to_pylist(), q["v"].to_pylist(), strict=True):
            scores = np.zeros(len(ids), dtype=np.int64)
            for t, w in enumerate(vector[:dims]):
                if w:
                    where, weights = lists[t]
                    if where is None:
                        scores += weights * w
                    else:
                        scores[where] += weights * w
            rest = np.flatnonzero(ids != query)
            found = scores[rest]
            if len(found) > k:
                last = np.partition(found, len(found) - k)[len(found) - k]
                above = np.flatnonzero(found > last)
                pick = np.concatenate([above, np.flatnonzero(found == last)[: k - len(above)]])
            else:
                pick = np.arange(len(found))
            out.append((np.full(len(pick), query), ids[rest[pick]], found[pick]))
        cols = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64) for x in (zip(*out, strict=True) if out else ([], [], []))]
        return pa.table([pa.array(x) for x in cols], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query (vec_id, v of vectors)."""
    from pyspark.sql import Window

    ship(vectors.sparkSession)
    rows = written(vectors.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.monotonically_increasing_id().alias("row")), "vectors")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.max("v").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, dims, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    if (largest or 0) >= 2.0**63 * (1 - 1e-9):  # no product, nor any part of one, exceeds the largest square
        raise ValueError("components too large: inner products could exceed 64 bits")
    n_queries = queries.count()
    block = max(1, min(CANDIDATE_BLOCK, BLOCK_CELLS // max(dims or 1, 1)))
    across, down = max(1, -(-n // block)), max(1, -(-n_queries // QUERY_BLOCK))
    q = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(down)).alias("s")).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    c = rows.select("vec_id", "v", F.pmod(F.xxhash64("row"), F.lit(across)).alias("t")).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
    cells = q.groupBy("s", "t").cogroup(c.groupBy("s", "t")).applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return cells.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score")
