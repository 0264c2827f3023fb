"""Edge table operators: merge, degrees, roles, hubs, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica import schemas as S
from lattica.functions import scalar as fn


def merge_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """One edge for each (source_id, target_id).

    In order of `order`: the first type stands, but an import that is anywhere rendered is RENDERS;
    RENDERS weighs nothing, else weights add up; called names unite; the last binding stands; an
    edge is dead or synthetic if all are; lines are the first known. One shuffle with partial
    aggregation: order is compared inside min_by and max_by, nothing is sorted.
    """
    at = F.struct(*order)
    first = F.min_by("edge_type", at)
    merged = F.when((first == "BELONGS_TO_DOMAIN") & F.bool_or(F.col("edge_type") == "RENDERS"), "RENDERS").otherwise(first)
    line = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at))
    out = edges.groupBy("source_id", "target_id").agg(
        merged.alias("edge_type"),
        F.sum("weight").alias("total"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("called_names", F.array().cast("array<string>")))))).alias("called_names"),
        F.max_by("binding", at).alias("binding"),
        F.bool_and("is_dead_import").alias("is_dead_import"),
        F.bool_and("is_synthetic").alias("is_synthetic"),
        line("source_line").alias("source_line"),
        line("target_line").alias("target_line"),
    )
    return out.withColumn("weight", F.when(F.col("edge_type") == "RENDERS", 0.0).otherwise(F.col("total"))).drop("total")


def is_structural(kind: Column, weight: Column) -> Column:
    return ~kind.isin(*S.NON_STRUCTURAL) & (weight > 0)


def is_journey(kind: Column, synthetic: Column) -> Column:
    """Runtime links always, imports unless synthetic."""
    return kind.isin(*S.CONTRACT_TYPES) | (kind.isin(*S.IMPORT_TYPES) & ~synthetic)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, in_degree, out_degree: edges counted without contract types; 0 for isolated nodes."""
    used = edges.where(~F.col("edge_type").isin(*S.CONTRACT_TYPES))
    ends = used.select(F.col("source_id").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(used.select(F.col("target_id").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    counted = ends.groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("node_id").join(counted, "node_id", "left").na.fill(0, ["in_degree", "out_degree"])


def role(in_degree: Column, out_degree: Column) -> Column:
    return F.when((in_degree == 0) & (out_degree > 0), "ENTRY_POINT").when((out_degree == 0) & (in_degree > 0), "TERMINAL_SINK").otherwise("INTERNAL")


def roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).withColumn("execution_role", role(F.col("in_degree"), F.col("out_degree")))


def local_roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Roles inside each cluster: only edges with both ends in it count; shared dependencies stay."""
    where = nodes.select("node_id", "cluster_id")
    inner = edges.join(where.toDF("source_id", "sc"), "source_id").join(where.toDF("target_id", "tc"), "target_id").where("sc = tc").drop("sc", "tc")
    found = roles(nodes, inner)
    if "execution_role" in nodes.columns:
        found = found.join(nodes.select("node_id", F.col("execution_role").alias("before")), "node_id")
        found = found.withColumn("execution_role", F.when(F.col("before") == "SHARED_DEPENDENCY", F.col("before")).otherwise(F.col("execution_role"))).drop("before")
    return found


def shared_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that import nothing and are imported by more than a tenth of all nodes."""
    d = degrees(nodes, edges)
    n = d.agg(F.count("*").alias("n"))
    share = F.col("in_degree") / F.col("n")
    return d.crossJoin(F.broadcast(n)).where((F.col("out_degree") == 0) & (share > S.SHARED_IN_RATIO)).select("node_id", F.lit("SHARED_DEPENDENCY").alias("execution_role"), F.lit(True).alias("is_god_file"), fn.half_up(share, 4).alias("centrality_score"))


def without_shared(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that remain once shared dependencies are taken out."""
    shared = shared_dependencies(nodes, edges).select("node_id")
    kept = edges.join(shared.withColumnRenamed("node_id", "target_id"), "target_id", "left_anti").join(shared.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti")
    return nodes.join(shared, "node_id", "left_anti"), kept


def orchestrators(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nobody imports and that import more than 15 % of the nodes left after the shared ones."""
    n_, e_ = without_shared(nodes, edges)
    d = degrees(n_, e_)
    n = d.agg(F.count("*").alias("n"))
    return d.crossJoin(F.broadcast(n)).where((F.col("in_degree") == 0) & (F.col("out_degree") / F.col("n") > S.ORCHESTRATOR_OUT_RATIO)).select("node_id", "out_degree")


def boost_tests(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Weight 50 for what test files import; paths: node_id, canonical_path."""
    tests = paths.where(fn.is_test(F.col("canonical_path"))).select(F.col("node_id").alias("source_id"), F.lit(True).alias("tested"))
    found = edges.join(tests, "source_id", "left")
    return found.withColumn("weight", F.when(F.col("tested"), S.TEST_BOOST).otherwise(F.col("weight"))).drop("tested")


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")


def flattened(edges: DataFrame, paths: DataFrame, order: list[str]) -> DataFrame:
    """Edges by path: the first of each pair, dangling ones dropped, weights rounded to 4 places."""
    first = edges.groupBy("source_id", "target_id").agg(F.min_by(F.struct("edge_type", "weight"), F.struct(*order)).alias("e"))
    p = paths.select("node_id", "canonical_path")
    named = first.join(p.toDF("source_id", "source"), "source_id").join(p.toDF("target_id", "target"), "target_id")
    return named.select("source", "target", F.col("e.edge_type").alias("type"), fn.half_up(F.col("e.weight"), 4).alias("weight"))
