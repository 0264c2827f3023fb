"""Hierarchical clusters: directory buckets, merges, community splits, reassignment and absorption."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica import schemas as S
from lattica.functions import scalar as fn
from lattica.operators import vectors as vec
from lattica.operators.communities import communities as communities_of
from lattica.operators.edges import is_structural
from lattica.operators.graph import connected_components
from lattica.operators.joins import looked_up
from lattica.session import ship, written

WORKER = 200_000  # nodes and links of a bucket that one worker splits
PLACED = "node_id, member: a node placed by its vector, and the member of the new cluster that it is nearest to"


def adaptive_buckets(files: DataFrame, large: int = S.MAX_CLUSTER_SIZE * 5) -> DataFrame:
    """node_id, bucket: directories of depth 2; those over `large` go a level deeper, twice at most,
    where that makes more than one group. files: node_id, canonical_path."""
    out = files.select("node_id", "canonical_path", fn.canonical_bucket(F.col("canonical_path"), 2).alias("bucket"))
    for depth in (3, 4):
        w = Window.partitionBy("bucket")
        deeper = fn.canonical_bucket(F.col("canonical_path"), depth)
        out = out.withColumn("deep", deeper).withColumn("n", F.count("*").over(w)).withColumn("same", F.min("deep").over(w) == F.max("deep").over(w))
        out = out.withColumn("bucket", F.when((F.col("n") > large) & ~F.col("same"), F.col("deep")).otherwise(F.col("bucket"))).drop("deep", "n", "same")
    return out.select("node_id", "bucket")


class _Weighted:
    """An undirected weighted graph of groups of nodes, for community search."""

    def __init__(self, groups: dict, weights: dict[tuple, float], resolution: float) -> None:
        self.groups, self.weights, self.resolution = groups, weights, resolution
        self.adjacent: dict = defaultdict(dict)
        self.degree: dict = defaultdict(float)
        self.total = sum(weights.values())
        for (a, b), w in weights.items():
            self.degree[a] += w
            self.degree[b] += w
            if a != b:
                self.adjacent[a][b] = self.adjacent[a].get(b, 0) + w
                self.adjacent[b][a] = self.adjacent[b].get(a, 0) + w

    def moved(self, label: dict, inside: dict | None = None) -> bool:
        """Moves groups to the community with the greatest gain until none gains; whether any moved.

        With `inside`, a group only joins communities of its own part, and only while it is alone."""
        volume: dict = defaultdict(float)
        count: dict = defaultdict(int)
        for v, c in label.items():
            volume[c] += self.degree[v]
            count[c] += 1
        ever, changed = False, bool(self.total)
        while changed:  # every move raises the modularity, so this ends
            changed = False
            for v in sorted(self.groups):
                own = label[v]
                if inside is not None and count[own] > 1:
                    continue
                toward: dict = defaultdict(float)
                for u, w in self.adjacent[v].items():
                    if inside is None or inside[u] == inside[v]:
                        toward[label[u]] += w
                volume[own] -= self.degree[v]
                gain = {c: round(toward.get(c, 0) - self.resolution * volume[c] * self.degree[v] / (2 * self.total), 12) for c in {own, *toward}}
                best = min(gain, key=lambda c: (-gain[c], c != own, c))
                volume[best] += self.degree[v]
                if best != own:
                    label[v], changed, ever = best, True, True
                    count[own] -= 1
                    count[best] += 1
        return ever

    def joined(self, label: dict) -> tuple[_Weighted, dict]:
        """The graph of the labels' groups, named after their smallest nodes, and each group's new name."""
        merged: dict = defaultdict(set)
        for v, m in self.groups.items():
            merged[label[v]] |= m
        names = {c: min(m) for c, m in merged.items()}
        weights: dict = defaultdict(float)
        for (a, b), w in self.weights.items():
            weights[tuple(sorted((names[label[a]], names[label[b]])))] += w
        return _Weighted({names[c]: m for c, m in merged.items()}, weights, self.resolution), {v: names[label[v]] for v in self.groups}


def communities(nodes: list, links: dict[tuple, float], resolution: float = 1.0, refine: bool = False) -> dict:
    """Communities by modularity gain (Louvain); nodes in order, ties to the smaller label, so always the same.

    With `refine` (Leiden), a community is taken apart into well-connected parts before the next
    level, which starts from the community but can move the parts on their own."""
    graph = _Weighted({v: {v} for v in nodes}, {k: w for k, w in links.items() if w > 0}, resolution)
    start = {v: v for v in graph.groups}
    while True:
        label = dict(start)
        moved = graph.moved(label)
        if not moved and len(set(label.values())) == len(label):
            break
        parts = label
        if refine:
            parts = {v: v for v in graph.groups}
            graph.moved(parts, label)
        smaller, name = graph.joined(parts)
        first: dict = {}
        for v in sorted(graph.groups):
            first.setdefault(label[v], name[v])
        start = {name[v]: first[label[v]] for v in graph.groups}
        if len(smaller.groups) == len(graph.groups):
            graph, start = graph.joined(label)[0], None
            start = {v: v for v in graph.groups}
            continue
        graph = smaller
    return {v: min(m) for m in graph.groups.values() for v in m}


def louvain(nodes: list, links: dict[tuple, float], resolution: float = 1.0) -> dict:
    return communities(nodes, links, resolution)


def leiden(nodes: list, links: dict[tuple, float], resolution: float = 1.0) -> dict:
    return communities(nodes, links, resolution, refine=True)


def split(nodes: list, links: dict[tuple, float], most: int, prefix: str, resolution: float = S.SPLIT_RESOLUTION) -> list[tuple[str, str | None, list]]:
    """(cluster, parent, nodes): communities, split again until none is over `most`; even chunks where
    no community is found. Parents stand before their children."""
    if len(nodes) <= most:
        return [(prefix, None, nodes)]
    members = set(nodes)
    inner = {k: w for k, w in links.items() if k[0] in members and k[1] in members}
    found: dict = defaultdict(list)
    for v, c in sorted(leiden(nodes, inner, resolution).items()) if inner else ():
        found[c].append(v)
    if len(found) <= 1:
        ordered = sorted(nodes)
        return [(f"{prefix}.{i // most}", None, ordered[i : i + most]) for i in range(0, len(ordered), most)]
    out: list[tuple[str, str | None, list]] = [(prefix, None, nodes)]
    for i, c in enumerate(sorted(found)):
        for name, parent, vs in split(found[c], inner, most, f"{prefix}.{i}", resolution):
            out.append((name, parent or prefix, vs))
    return out


def _inside(buckets: DataFrame, edges: DataFrame) -> DataFrame:
    """bucket, a, b, w: the structural links inside each bucket, a pair once."""
    side = lambda i, b: buckets.toDF(i, b)
    inner = edges.where(is_structural(F.col("edge_type"), F.col("weight")) & (F.col("source_id") != F.col("target_id"))).join(side("source_id", "bucket"), "source_id").join(side("target_id", "tb"), "target_id").where("bucket = tb")
    return inner.groupBy("bucket", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.max("weight").alias("w"))


def _split_in_workers(buckets: DataFrame, links: DataFrame, most: int) -> DataFrame:
    def run(key, vs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        w = dict(zip(zip(es["a"], es["b"], strict=True), es["w"], strict=True))
        if not len(vs):
            return pd.DataFrame({"cluster_id": [], "parent_id": [], "node_id": [], "is_leaf": []})
        rows = split(sorted(vs["node_id"].tolist()), w, most, str(key[0]))
        parents = {p for _, p, _ in rows if p}
        return pd.DataFrame([(c, p, v, c not in parents) for c, p, ns in rows for v in ns], columns=["cluster_id", "parent_id", "node_id", "is_leaf"])

    kind = buckets.schema["node_id"].dataType.simpleString()
    return buckets.groupBy("bucket").cogroup(links.groupBy("bucket")).applyInPandas(run, f"cluster_id string, parent_id string, node_id {kind}, is_leaf boolean")


def _ranked(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """rows with the dense rank (from 0) of value under by, without a task that holds all of one key."""
    values = written(rows.select(by, value).distinct().repartitionByRange(by, value).sortWithinPartitions(by, value).withColumn("part", F.spark_partition_id()), "ranked")
    sizes = values.groupBy(by, "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select(by, "part", F.coalesce("before", F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part", by).orderBy(value)) - 1
    numbers = values.withColumn("own", own).join(before, [by, "part"]).select(by, value, (F.col("before") + F.col("own")).alias(name))
    return rows.join(numbers, [by, value])


def split_buckets(buckets: DataFrame, edges: DataFrame, most: int = S.MAX_CLUSTER_SIZE, worker: int = WORKER) -> DataFrame:
    """cluster_id, parent_id, node_id, is_leaf; each bucket is split on its own.

    buckets: node_id, bucket; edges: source_id, target_id, weight, edge_type. A bucket whose nodes and
    links are `worker` at most is split by one worker, and only the links inside it travel with it. A
    larger one is first divided into communities by rounds over all workers, again and again at higher
    resolution until the parts fit, or into even chunks if there is one community only; the parts stand
    below it as its children."""
    ship(buckets.sparkSession)
    links = written(_inside(buckets, edges), "inner")
    todo, parents, done = written(buckets.select("node_id", "bucket", F.lit(None).cast("string").alias("parent_id")), "todo"), [], []
    resolution = 1.0
    while True:
        sizes = todo.groupBy("bucket").agg(F.count("*").alias("n")).join(links.groupBy("bucket").agg(F.count("*").alias("m")), "bucket", "left")
        large = written(sizes.where(F.col("n") + F.coalesce("m", F.lit(0)) > worker).where(F.col("n") > most).select("bucket"), "large")
        done.append((todo.join(large, "bucket", "left_anti"), links.join(large, "bucket", "left_anti")))
        if large.isEmpty():
            break
        nodes, inner = written(todo.join(large, "bucket", "left_semi"), "nodes"), written(links.join(large, "bucket", "left_semi"), "inner")
        found = communities_of(nodes.select(F.col("node_id").alias("node")), inner.select("a", "b", "w"), resolution)
        resolution *= S.SPLIT_RESOLUTION
        part = nodes.join(found.withColumnRenamed("node", "node_id"), "node_id")
        single = part.groupBy("bucket").agg(F.min("community").alias("least"), F.max("community").alias("greatest")).where("least = greatest").select("bucket")
        chunked = _ranked(part.join(single, "bucket", "left_semi").drop("community"), "bucket", "node_id", "at").withColumn("child", F.floor(F.col("at") / most))
        divided = _ranked(part.join(single, "bucket", "left_anti"), "bucket", "community", "child")
        below = F.concat_ws(".", "bucket", F.col("child").cast("string"))
        rows = chunked.select("node_id", below.alias("child"), F.col("parent_id").alias("above"), "bucket", "parent_id", F.lit(False).alias("kept"))
        rows = written(rows.unionByName(divided.select("node_id", below.alias("child"), F.col("bucket").alias("above"), "bucket", "parent_id", F.lit(True).alias("kept"))), "parts")
        parents.append(rows.where("kept").select(F.col("bucket").alias("cluster_id"), "parent_id", "node_id", F.lit(False).alias("is_leaf")))
        todo = rows.select("node_id", F.col("child").alias("bucket"), F.col("above").alias("parent_id"))
        where = todo.select("node_id", "bucket")
        links = written(inner.drop("bucket").join(where.toDF("a", "bucket"), "a").join(where.toDF("b", "tb"), "b").where("bucket = tb").select("bucket", "a", "b", "w"), "inner")
    out = None
    for rows, inner in done:
        leaves = _split_in_workers(rows.select("node_id", "bucket"), inner, most)
        above = rows.select("node_id", F.col("parent_id").alias("above"))
        named = leaves.join(above, "node_id").select("cluster_id", F.coalesce("parent_id", "above").alias("parent_id"), "node_id", "is_leaf")
        out = named if out is None else out.unionByName(named)
    for p in parents:
        out = out.unionByName(p)
    return out


def bucket_flows(buckets: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, w: structural weight between two buckets, either direction."""
    e = edges.where(is_structural(F.col("edge_type"), F.col("weight")))
    j = e.join(buckets.toDF("source_id", "sb"), "source_id").join(buckets.toDF("target_id", "tb"), "target_id").where("sb <> tb")
    return j.select(F.explode(F.array(F.struct(F.col("sb").alias("a"), F.col("tb").alias("b")), F.struct(F.col("tb").alias("a"), F.col("sb").alias("b")))).alias("x"), "weight").groupBy("x.a", "x.b").agg(F.sum("weight").alias("w"))


def _heaviest(small: DataFrame, flows: DataFrame) -> DataFrame:
    """bucket, target: the neighbour with the greatest weight, ties by name."""
    return flows.join(small.select(F.col("bucket").alias("a")), "a").groupBy(F.col("a").alias("bucket")).agg(F.min_by("b", F.struct(-F.col("w"), F.col("b"))).alias("target"))


_PLACES = 10  # components whose sets of places are all written out


def closest_directory(small: DataFrame, every: DataFrame) -> DataFrame:
    """bucket, target: the other bucket with most components equal at the same place, ties by name.

    Both: bucket. A bucket has a key for each set of places with the components there, and two buckets
    agree in a set if they share its key; so no bucket meets all others below a common directory. Of
    each key the two first buckets by name are enough. A small bucket of more than ten components, which
    adaptive depths don't reach, is compared with every bucket that shares a place instead. Where no
    place is shared, the first other bucket by name is the target."""
    parts = F.split("bucket", "/")
    keys = lambda d: d.select("bucket", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.least(F.size(parts), F.lit(_PLACES))).cast("int") - 1)).alias("places")).withColumn("key", F.transform(parts, lambda x, i: F.when((i < _PLACES) & (F.expr("places").bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0), x)))
    trimmed = lambda d: keys(d).withColumn("key", F.slice("key", F.lit(1), F.length(F.bin("places"))))  # noqa: E731  (up to the last place of the set)
    held = written(trimmed(every), "places")
    firsts = held.groupBy("places", "key").agg(F.min("bucket").alias("first"), F.count("*").alias("n")).where("n > 1")
    seconds = held.join(firsts, ["places", "key"]).where(F.col("bucket") != F.col("first")).groupBy("places", "key").agg(F.min("bucket").alias("second"))
    known = written(firsts.join(seconds, ["places", "key"]), "groups")
    deep = F.size(parts) > _PLACES
    asked = written(trimmed(small.where(~deep)), "places")
    found = looked_up(asked, known, ["places", "key"], F.col("n"), asked.count()).where("first is not null")
    other = F.when(F.col("first") != F.col("bucket"), F.col("first")).otherwise(F.col("second"))
    best = found.withColumn("other", other).where("other is not null").groupBy("bucket").agg(F.min_by("other", F.struct(-F.bit_count("places"), F.col("other"))).alias("target"))
    single = lambda d, n: d.select(F.col("bucket").alias(n), F.posexplode(parts).alias("i", "part"))
    shared = single(small.where(deep), "bucket").join(single(every, "other"), ["i", "part"]).where("bucket <> other").groupBy("bucket", "other").agg(F.count("*").alias("n"))
    best = best.unionByName(shared.groupBy("bucket").agg(F.min_by("other", F.struct(-F.col("n"), F.col("other"))).alias("target")))
    ends = every.orderBy("bucket").limit(2).agg(F.array_sort(F.collect_list("bucket")).alias("first"))
    alone = small.select("bucket").join(best, "bucket", "left_anti").crossJoin(F.broadcast(ends))
    at = F.when(F.get("first", F.lit(0)) != F.col("bucket"), F.get("first", F.lit(0))).otherwise(F.get("first", F.lit(1)))
    return best.unionByName(alone.select("bucket", at.alias("target")).where("target is not null"))


def _by_vectors(small: DataFrame, homes: DataFrame, buckets: DataFrame, vectors: DataFrame) -> DataFrame:
    """bucket, target: the home whose centroid is nearest to the bucket's; nothing for buckets without vectors."""
    held = buckets.join(vectors, "node_id").select("bucket", "v")
    c = vec.centroids(held, "bucket")
    homes_c = c.join(homes.select("bucket"), "bucket", "left_semi")
    asked = c.join(small.select("bucket"), "bucket", "left_semi").select(F.col("bucket").alias("id"), F.col("centroid").alias("v"))
    # a bucket is its own nearest one: for each, the best of the others counts
    pairs = vec.nearest_member(asked.withColumn("grp", F.lit(0)), homes_c.select(F.col("bucket").alias("id"), F.lit(0).alias("grp"), F.col("centroid").alias("v")))
    return pairs.select(F.col("id").alias("bucket"), F.col("best").alias("target"))


def _nearest_in(placed: DataFrame, members: DataFrame, vectors: DataFrame) -> DataFrame:
    """node_id, member of nodes that a vector has placed; placed: node_id, target; members: node_id, bucket."""
    q = placed.join(vectors, "node_id").select(F.col("node_id").alias("id"), F.col("target").alias("grp"), "v")
    m = members.join(vectors, "node_id").select(F.col("node_id").alias("id"), F.col("bucket").alias("grp"), "v")
    return vec.nearest_member(q, m).select(F.col("id").alias("node_id"), F.col("best").alias("member"))


def semantic_edges(placed: DataFrame, existing: DataFrame) -> DataFrame:
    """SEMANTIC_SIMILARITY edges from placed nodes to their nearest members, where no edge is yet."""
    from lattica.operators.infer import PAIR, synthetic

    pairs = placed.select(F.col("node_id").alias("source_id"), F.col("member").alias("target_id")).distinct()
    return synthetic(pairs.join(existing.select(PAIR), PAIR, "left_anti"), "SEMANTIC_SIMILARITY", S.SEMANTIC_WEIGHT)


def merged_small(buckets: DataFrame, edges: DataFrame, least: int = S.MIN_CLUSTER_SIZE, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """node_id, bucket once no bucket is under `least` nodes while there is another one; and what vectors have placed.

    A small bucket joins its heaviest neighbour, else the one with the nearest centroid (vectors:
    node_id, v), else the closest directory. All small buckets choose at once; those that choose
    each other or form a chain become one (components of the choices), named after its largest
    bucket. This is repeated until nothing changes: every round at least halves the small ones."""
    placed = None
    while True:
        buckets = written(buckets.select("node_id", "bucket"), "buckets")
        sizes = written(buckets.groupBy("bucket").agg(F.count("*").alias("n")), "sizes")
        small = sizes.where(F.col("n") < least).select("bucket")
        if small.isEmpty() or sizes.limit(2).count() < 2:
            return buckets, placed
        chosen = _heaviest(small, bucket_flows(buckets, edges))
        rest = small.join(chosen, "bucket", "left_anti")
        if vectors is not None:
            near = written(_by_vectors(rest, sizes, buckets, vectors), "near")
            fresh = _nearest_in(buckets.join(near, "bucket").select("node_id", "target"), buckets, vectors)
            placed = written(fresh if placed is None else placed.unionByName(fresh), "placed")
            chosen, rest = chosen.unionByName(near), rest.join(near, "bucket", "left_anti")
        chosen = written(chosen.unionByName(closest_directory(rest, sizes)), "chosen")
        groups = connected_components(chosen, "bucket", "target").withColumnRenamed("node", "bucket")
        names = groups.join(sizes, "bucket").groupBy("component").agg(F.min_by("bucket", F.struct(-F.col("n"), F.col("bucket"))).alias("into"))
        buckets = buckets.join(groups.join(names, "component").select("bucket", "into"), "bucket", "left").select("node_id", F.coalesce("into", "bucket").alias("bucket"))


def merge_small(buckets: DataFrame, edges: DataFrame, least: int = S.MIN_CLUSTER_SIZE) -> DataFrame:
    """node_id, bucket as of `merged_small`, without vectors."""
    return merged_small(buckets, edges, least)[0]


def reassigned(heads: DataFrame, members: DataFrame, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """members (node_id, bucket) and the heads: each in the cluster with the nearest centroid, or in one of its own.

    heads: node_id. Also gives what vectors have placed."""
    own = heads.select("node_id", F.concat(F.lit("head/"), F.col("node_id").cast("string")).alias("bucket"))
    if vectors is None:
        return members.unionByName(own), None
    c = vec.centroids(members.join(vectors, "node_id").select("bucket", "v"), "bucket")
    found = vec.nearest_centroid(heads.join(vectors, "node_id").select(F.col("node_id").alias("id"), "v"), c, "bucket").select(F.col("id").alias("node_id"), F.col("best").alias("target"))
    placed = _nearest_in(found, members, vectors)
    home = own.join(found, "node_id", "left").select("node_id", F.coalesce("target", "bucket").alias("bucket"))
    return members.unionByName(home), placed


def absorbed(members: DataFrame, edges: DataFrame, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """node_id, bucket once clusters of one node have joined a cluster of several, and what vectors have placed.

    A single node joins the cluster that it has most structural weight with, else the one with the
    nearest centroid; without either it stays alone."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
    several = sizes.where("n > 1").select("bucket")
    single = sizes.where("n = 1").select("bucket")
    chosen = _heaviest(single, bucket_flows(members, edges).join(several.toDF("b"), "b"))
    placed = None
    if vectors is not None:
        rest = members.join(single.join(chosen, "bucket", "left_anti"), "bucket").join(vectors, "node_id")
        c = vec.centroids(members.join(several, "bucket").join(vectors, "node_id").select("bucket", "v"), "bucket")
        near = vec.nearest_centroid(rest.select(F.col("node_id").alias("id"), "v"), c, "bucket")
        near = near.join(rest.select(F.col("node_id").alias("id"), "bucket"), "id").select("id", "bucket", F.col("best").alias("target"))
        placed = _nearest_in(near.select(F.col("id").alias("node_id"), "target"), members, vectors)
        chosen = chosen.unionByName(near.select("bucket", "target"))
    return members.join(chosen, "bucket", "left").select("node_id", F.coalesce("target", "bucket").alias("bucket")), placed


def absorb_singletons(members: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, bucket as of `absorbed`, without vectors."""
    return absorbed(members, edges)[0]


def leaves(membership: DataFrame) -> DataFrame:
    """node_id, cluster_id: the deepest cluster that holds each node."""
    return membership.where("is_leaf").select("node_id", "cluster_id")
