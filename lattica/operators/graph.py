"""Iterative graph operators on edge DataFrames; every round is written, so lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lattica.session import dropped, written

HEAVY = 1000  # a node with more than this fraction (1 / HEAVY) of all edge ends is heavy; so there are fewer than HEAVY


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges (u, v), written, with their number and a sum of their hashes."""
    seen = Observation()
    out = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "cc")
    return out, (seen.get["n"], seen.get["h"])


def _with_smallest(pairs: DataFrame, rows: int) -> DataFrame:
    """pairs (u, v) and m, the smallest v of their u.

    The minimum is aggregated before the shuffle. Heavy nodes, fewer than HEAVY by their definition,
    get theirs by a broadcast, so their pairs stay where they are; the other pairs are joined by u."""
    stats = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    bound = 1 << max(0, rows // HEAVY).bit_length()  # few different numbers, so rounds share their generated code
    heavy = stats.where(F.col("n") > bound).select("u", F.col("m").alias("heavy_m"))
    marked = pairs.join(F.broadcast(heavy), "u", "left")
    light = marked.where("heavy_m is null").select("u", "v").join(stats.where(F.col("n") <= bound).select("u", "m"), "u")
    return light.select("u", "v", "m").unionByName(marked.where("heavy_m is not null").select("u", "v", F.col("heavy_m").alias("m")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (the smallest node reached): components of an undirected graph.

    Large-star and small-star rounds: each node's neighbours are re-linked to its smallest one
    until every node hangs on its component's smallest and nothing changes; every round either
    links a node to a smaller one or is the last. Self loops and edges with a null end are ignored.
    """
    u, v = F.col(src), F.col(dst)
    found, before = _written(edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    while before[0]:
        both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stars = _with_smallest(both, 2 * before[0]).withColumn("m", F.least("m", "u"))
        large = stars.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_smallest(large, before[0])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(large.groupBy("u").agg(F.min("v").alias("v")))
        new, after = _written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        dropped(found)
        found = new
        if after == before:
            break
        before = after
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, node: everything that each root reaches along directed edges, itself included.

    edges: src, dst; roots: root. A breadth-first frontier of (root, node) pairs; each round joins
    the frontier with the edges, drops what is known, and is written. It ends when nothing is new.
    """
    e = written(edges.select("src", "dst").distinct(), "bfs")
    seen = frontier = written(roots.select("root", F.col("root").alias("node")).distinct(), "bfs")
    parts = [seen]
    while True:
        nxt = frontier.join(e, frontier["node"] == e["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = written(nxt.join(seen, ["root", "node"], "left_anti"), "bfs")
        if frontier.isEmpty():
            return seen
        parts.append(frontier)
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionByName(p)
        if len(parts) > 8:
            seen = written(seen, "bfs")
            dropped(*parts[:-1])
            parts = [seen]


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int, decay: float, tolerance: float) -> DataFrame:
    """node, domain, score: seed labels spread over weighted undirected edges (Jacobi rounds).

    edges: src, dst, weight (parallel edges count each); seeds: node, domain, score. A node's next
    score is decay times the weighted mean of its neighbours' scores; seeds keep theirs. Stops when
    no score changes by the tolerance. Scores stay in long form, so zeros take no space. Old and new
    scores meet in one aggregation, and the largest change is observed while a round is written.
    """
    e = edges.where("weight > 0 and src <> dst")
    both = e.select("src", "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    degree = both.groupBy("dst").agg(F.sum("weight").alias("degree"))
    fixed = written(seeds.select("node", "domain", "score"), "prop")
    held = fixed.select("node").distinct()
    free = both.join(degree, "dst").join(held, F.col("dst") == held["node"], "left_anti")  # seeds are told nothing
    links = written(free.select("src", "dst", (F.col("weight") / F.col("degree")).alias("share")), "prop")
    zero = F.lit(0.0)
    state = fixed.select("node", "domain", "score", F.lit(True).alias("seed"))
    last = None
    for _ in range(rounds):
        told = links.join(state, links["src"] == state["node"]).select(F.col("dst").alias("node"), "domain", (F.col("share") * F.col("score")).alias("told"), zero.alias("old"), F.lit(False).alias("seed"))
        kept = state.select("node", "domain", zero.alias("told"), F.col("score").alias("old"), "seed")
        merged = told.unionByName(kept).groupBy("node", "domain").agg(F.sum("told").alias("told"), F.sum("old").alias("old"), F.bool_or("seed").alias("seed"))
        new = merged.select("node", "domain", F.when(F.col("seed"), F.col("old")).otherwise(F.col("told") * decay).alias("score"), "seed", "old")
        change = Observation()
        new = written(new.observe(change, F.max(F.abs(F.col("score") - F.col("old"))).alias("d")).select("node", "domain", "score", "seed"), "prop")
        if last is not None:
            dropped(last)
        state = last = new
        d = change.get["d"]
        if d is None or d < tolerance:
            break
    return state.select("node", "domain", "score")


def propagate_rounds(edges: DataFrame, seeds: DataFrame, rounds: int, decay: float) -> DataFrame:
    """The scores after a fixed number of rounds."""
    return propagate(edges, seeds, rounds, decay, -1.0)
