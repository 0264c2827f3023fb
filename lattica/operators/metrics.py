"""Partition metrics and the evaluation of a node's move to another cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import scalar as fn


def with_scenarios(membership: DataFrame, node: str, target: str) -> DataFrame:
    """membership twice: as it is, and with one node moved."""
    both = membership.withColumn("scenario", F.explode(F.array(F.lit("before"), F.lit("after"))))
    moved = (F.col("scenario") == "after") & (F.col("node_id") == node)
    return both.withColumn("cluster_id", F.when(moved, F.lit(target)).otherwise(F.col("cluster_id")))


def _scored(flows: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """The metrics of partitions, given the weight between clusters (sc, tc, w) and their sizes (cluster_id, size)."""
    ends = flows.withColumn("x", F.explode(F.array(F.struct(F.col("sc").alias("c"), F.col("w").alias("d"), F.when(F.expr("sc = tc"), F.col("w")).otherwise(0.0).alias("i")), F.struct(F.col("tc").alias("c"), F.col("w").alias("d"), F.lit(0.0).alias("i")))))
    per = ends.groupBy(*by, F.col("x.c").alias("cluster_id")).agg(F.sum("x.d").alias("degree"), F.sum("x.i").alias("inside"))
    joined = sizes.join(per, [*by, "cluster_id"], "left").na.fill(0.0, ["degree", "inside"])
    totals = joined.groupBy(*by).agg(
        (F.sum("degree") / 2).alias("total"),
        F.sum("inside").alias("internal"),
        F.sum(F.col("degree") * F.col("degree")).alias("squares"),
        F.count("*").alias("clusters"),
        F.sum("size").alias("nodes"),
        F.sum(F.col("size") * F.ln("size")).alias("plogp"),
    )
    w = F.col("total")
    part = lambda x: F.when(w > 1e-9, x).otherwise(0.0)
    entropy = F.ln("nodes") - F.col("plogp") / F.col("nodes")
    balance = F.when(F.col("nodes") <= 1, 100.0).when(F.col("clusters") <= 1, 0.0).otherwise(entropy / F.ln("clusters") * 100)
    out = totals.select(*by, part(F.col("internal") / w - F.col("squares") / (4 * w * w)).alias("modularity"), part(F.col("internal") / w * 100).alias("cohesion"), part((w - F.col("internal")) / w * 100).alias("coupling"), balance.alias("size_balance"))
    normal = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("modularity"))) + 1) / 2
    return out.withColumn("graph_score", 55 * normal + 0.35 * F.col("cohesion") + 0.10 * F.col("size_balance"))


def _placed(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """source_id, target_id, weight, sc, tc of the weighted edges between members."""
    side = lambda i, c: membership.select(F.col("node_id").alias(i), F.col("cluster_id").alias(c))
    e = edges.where("weight > 0").groupBy("source_id", "target_id").agg(F.sum("weight").alias("weight"))
    return e.join(side("source_id", "sc"), "source_id").join(side("target_id", "tc"), "target_id")


def partition_metrics(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """modularity, cohesion, coupling, size_balance and graph_score of a partition.

    membership: node_id, cluster_id; edges: source_id, target_id, weight. Edges without weight or
    with an unknown end don't count."""
    flows = _placed(membership, edges).groupBy("sc", "tc").agg(F.sum("weight").alias("w"))
    return _scored(flows, membership.groupBy("cluster_id").agg(F.count("*").alias("size")), [])


def move_preview(membership: DataFrame, edges: DataFrame, node: str, target: str) -> DataFrame:
    """Metrics before and after a node's move, sizes of both clusters, the change of quality, a verdict and its reasons (measures with direction and change).

    The edges are joined with their clusters once; only the moved node's own ends differ after."""
    by = ["scenario"]
    placed = _placed(membership, edges).withColumn("scenario", F.explode(F.array(F.lit("before"), F.lit("after"))))
    at = lambda end, c: F.when((F.col("scenario") == "after") & (F.col(end) == node), F.lit(target)).otherwise(F.col(c))
    placed = placed.withColumns({"sc": at("source_id", "sc"), "tc": at("target_id", "tc")})
    flows = placed.groupBy("scenario", "sc", "tc").agg(F.sum("weight").alias("w"))
    sizes = with_scenarios(membership.select("node_id", "cluster_id"), node, target).groupBy("scenario", "cluster_id").agg(F.count("*").alias("size"))
    mine = placed.where((F.col("source_id") == node) | (F.col("target_id") == node)).groupBy(*by).agg((F.sum(F.when(F.expr("sc = tc"), F.col("weight")).otherwise(0.0)) / F.sum("weight") * 100).alias("placement"))
    scored = _scored(flows, sizes, by).join(mine, by, "left")
    quality = F.when(F.col("placement").isNull(), F.col("graph_score")).otherwise(0.75 * F.col("graph_score") + 0.25 * F.col("placement"))
    scored = scored.withColumn("quality", quality).withColumn("has_edges", F.col("placement").isNotNull()).withColumn("placement", F.coalesce("placement", F.lit(0.0)))
    names = ["modularity", "cohesion", "coupling", "size_balance", "placement", "quality"]
    pick = lambda c, s: F.max(F.when(F.col("scenario") == s, F.col(c)))
    one = scored.agg(*(pick(c, s).alias(f"{c}_{s}") for c in names for s in ("before", "after")), F.max("has_edges").alias("has_edges"))
    home = membership.where(F.col("node_id") == node).select(F.col("cluster_id").alias("from_cluster"))
    own = membership.groupBy("cluster_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(home)).groupBy("from_cluster").agg(F.max(F.when(F.expr("cluster_id = from_cluster"), F.col("n"))).alias("source_before"), F.coalesce(F.max(F.when(F.col("cluster_id") == target, F.col("n"))), F.lit(0)).alias("target_before"))
    own = own.select("from_cluster", "source_before", (F.col("source_before") - 1).alias("source_after"), "target_before", (F.col("target_before") + 1).alias("target_after"))
    rise = lambda c: F.col(f"{c}_after") - F.col(f"{c}_before")
    delta = rise("quality")
    verdict = F.when(delta > 0.10, "IMPROVES").when(delta < -0.10, "WORSENS").otherwise("NEUTRAL")
    shown = [fn.half_up(F.col(f"{c}_{s}"), 4).alias(f"{c}_{s}") for c in names for s in ("before", "after")] + [fn.half_up(rise(c), 4).alias(f"{c}_delta") for c in names]
    return one.crossJoin(own).select(*shown, "from_cluster", "source_before", "source_after", "target_before", "target_after", verdict.alias("verdict"), _reasons(rise).alias("reasons"))


def _reasons(rise) -> Column:
    """measure, direction (up, down, none where it can't be told) and change of what a move changes, the most direct first.

    Cluster sizes are named only if their balance changes by a hundredth or more."""

    def entry(measure: str, known: Column | None = None) -> Column:
        direction = F.when(rise(measure) >= 0, "up").otherwise("down")
        change = fn.half_up(rise(measure), 4)
        if known is not None:
            direction, change = F.when(known, direction).otherwise("none"), F.when(known, change)
        return F.struct(F.lit(measure).alias("measure"), direction.alias("direction"), change.alias("change"))

    balance = F.when(F.abs(rise("size_balance")) >= 0.01, entry("size_balance"))
    return F.array_compact(F.array(entry("placement", F.col("has_edges")), entry("modularity"), entry("cohesion"), balance))
