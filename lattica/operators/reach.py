"""What nodes reach along directed edges, without a row for each pair of them.

Nodes that reach each other have the same answer, so the graph is condensed to its strong components
first. Each component's reach is a set of bitmaps (32,768 numbered nodes each, built-in functions):
its own members and those of its successors, put together from the sinks upwards, a level of the
condensed graph a round. A set is one or a few binary values, however many nodes are in it, and
nodes of a component have neighbouring numbers.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.joins import looked_up
from lattica.session import dropped, settled, written


def _between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (node)."""
    return edges.join(nodes.toDF("src"), "src", "left_semi").join(nodes.toDF("dst"), "dst", "left_semi").select("src", "dst")


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Written edges between nodes that are entered and left, and their number: all others are on no cycle."""
    at, n = edges, edges.count()
    while n:
        new = written(_between(at, at.select(F.col("src").alias("node")).intersect(at.select(F.col("dst").alias("node")))), "scc")
        dropped(at)
        at, before, n = new, n, new.count()
        if n == before:
            break
    return at, n


def _colours(edges: DataFrame) -> DataFrame:
    """node, colour: the greatest node that reaches each node (itself included)."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    state = written(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("new")), "scc")
    while not state.where("new").isEmpty():
        told = edges.join(state.where("new"), edges["src"] == state["node"]).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("told"))
        grown = state.join(told, "node", "left").select("node", F.greatest("colour", F.coalesce("told", "colour")).alias("colour"), F.coalesce(F.col("told") > F.col("colour"), F.lit(False)).alias("new"))
        new = written(grown, "scc")
        dropped(state)
        state = new
    return state.select("node", "colour")


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (one of its nodes) of every end of an edge: nodes that reach each other.

    edges: src, dst; a null end is ignored. Forward and backward with trimming: nodes on no cycle are
    peeled off, each node is coloured by the greatest node that reaches it, and what reaches a colour's
    own node backwards inside the colour is a component. Each round settles one component of each colour at least."""

    def make() -> DataFrame:
        plain = edges.select("src", "dst").where("src is not null and dst is not null")
        every = written(plain.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "scc")
        at, n = _trimmed(written(plain.where("src <> dst").distinct(), "scc"))
        found: list[DataFrame] = []
        while n:
            colours = _colours(at)
            inside = at.join(colours.toDF("src", "a"), "src").join(colours.toDF("dst", "b"), "dst").where("a = b").select("src", "dst")
            inside = written(inside, "scc")
            seen = frontier = written(colours.where("node = colour"), "scc")
            parts = [seen]
            while not frontier.isEmpty():
                back = inside.join(frontier, inside["dst"] == frontier["node"]).select(F.col("src").alias("node"), "colour").distinct()
                frontier = written(back.join(seen, "node", "left_anti"), "scc")
                parts.append(frontier)
                seen = seen.unionByName(frontier)
            found += parts
            left = colours.join(seen, "node", "left_anti").select("node")
            at, n = _trimmed(written(_between(at, left), "scc"))
        if not found:
            return every.select("node", F.col("node").alias("component"))
        cyclic = found[0]
        for f in found[1:]:
            cyclic = cyclic.unionByName(f)
        return every.join(cyclic, "node", "left").select("node", F.coalesce("colour", "node").alias("component"))

    return settled(make, "components")


def _numbered(nodes: DataFrame) -> DataFrame:
    """nodes (node, component) with a dense number, neighbours in a component being neighbours in number."""
    ranged = written(nodes.repartitionByRange("component", "node").sortWithinPartitions("component", "node").withColumn("part", F.spark_partition_id()), "numbers")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")  # a row a partition
    rank = F.row_number().over(Window.partitionBy("part").orderBy("component", "node")) - 1
    return ranged.withColumn("rank", rank).join(F.broadcast(before), "part").select("node", "component", (F.col("before") + F.col("rank") + 1).alias("number"))


class Reach(NamedTuple):
    """node, component, members (how many nodes are in it); and component, bucket, bitmap."""

    nodes: DataFrame
    sets: DataFrame


def reach_sets(edges: DataFrame, roots: DataFrame | None = None) -> Reach:
    """What every node reaches, itself included; edges: src, dst; roots: node, for nodes without edges.

    The rounds are as many as the longest path of the condensed graph."""
    links = edges.select("src", "dst").where("src is not null and dst is not null")
    with_roots = links if roots is None else links.unionByName(roots.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    components = strong_components(with_roots)

    def place() -> DataFrame:
        n = _numbered(components)
        return n.join(n.groupBy("component").agg(F.count("*").alias("members")), "component").select("node", "component", "members", "number")

    nodes = settled(place, "places")
    dropped(components)

    def fold() -> DataFrame:
        to = nodes.select("node", "component")
        dag = links.join(to.toDF("src", "c"), "src").join(to.toDF("dst", "d"), "dst").where("c <> d").select("c", "d").distinct()
        dag = written(dag, "dag")
        own = nodes.groupBy("component", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"))
        own = written(own, "own")
        left = written(nodes.select("component").distinct(), "left")
        done: list[DataFrame] = []
        waiting = dag
        while not left.isEmpty():
            ready = written(left.join(waiting.select(F.col("c").alias("component")), "component", "left_anti"), "ready")
            mine = own.join(ready, "component", "left_semi")
            if done:
                below = dag.join(ready, dag["c"] == ready["component"], "left_semi")
                held = done[0]
                for x in done[1:]:
                    held = held.unionByName(x)
                told = below.join(held, below["d"] == held["component"]).select(F.col("c").alias("component"), "bucket", "bitmap")
                mine = mine.unionByName(told).groupBy("component", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
            done.append(written(mine.select("component", "bucket", "bitmap"), "sets"))
            next_left = written(left.join(ready, "component", "left_anti"), "left")
            waiting = written(waiting.join(ready, waiting["d"] == ready["component"], "left_anti"), "waiting")
            dropped(left)
            left = next_left
        if not done:
            return own
        held = done[0]
        for x in done[1:]:
            held = held.unionByName(x)
        return held

    return Reach(nodes, settled(fold, "reach"))


def reach_counts(reach: Reach, roots: DataFrame) -> DataFrame:
    """root, reached: how many nodes each root reaches, itself included; roots: root."""
    sizes = written(reach.sets.groupBy("component").agg(F.sum(F.bitmap_count("bitmap")).alias("reached")).join(reach.nodes.select("component", "members").distinct(), "component"), "sizes")
    at = written(roots.select("root").distinct().join(reach.nodes.select(F.col("node").alias("root"), "component"), "root"), "roots")
    return looked_up(at, sizes, ["component"], F.col("members"), reach.nodes.count()).select("root", "reached")


def union_counts(reach: Reach, groups: DataFrame) -> DataFrame:
    """group, reached: how many nodes any root of a group reaches; groups: group, root."""
    at = groups.select("group", F.col("root").alias("node")).join(reach.nodes.select("node", "component"), "node").select("group", "component").distinct()
    either = at.join(reach.sets, "component").groupBy("group", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return either.groupBy("group").agg(F.sum(F.bitmap_count("bitmap")).alias("reached"))


def reached_from_any(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node: everything that any of the starts (node) reaches, these included; a frontier of nodes alone."""

    def make() -> DataFrame:
        e = written(edges.select("src", "dst").distinct(), "bfs")
        seen = frontier = written(starts.select("node").where("node is not null").distinct(), "bfs")
        while not frontier.isEmpty():
            nxt = frontier.join(e, frontier["node"] == e["src"]).select(F.col("dst").alias("node")).where("node is not null").distinct()
            frontier = written(nxt.join(seen, "node", "left_anti"), "bfs")
            both = written(seen.unionByName(frontier), "bfs")
            dropped(seen)
            seen = both
        return seen

    return settled(make, "reached")

