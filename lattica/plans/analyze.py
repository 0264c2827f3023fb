"""The whole analysis of a code base as one chain of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import schemas as S
from lattica.functions import scalar as fn
from lattica.operators import analytics, cluster, domains, edges, infer, resolve
from lattica.operators import vectors as vec
from lattica.session import written
from lattica.sources import code


@dataclass
class Analysis:
    """The tables of an analysis."""

    nodes: DataFrame
    edges: DataFrame
    clusters: DataFrame
    entries: DataFrame
    coverage: DataFrame


def raw_edges(files: DataFrame, registry: DataFrame, aliases: DataFrame, packages: DataFrame) -> DataFrame:
    """Import edges with type, weight, binding, called names and whether the import is dead.

    files: code.extracted; registry: node_id, canonical_path. seq is the import's place in its file."""
    imports = files.select(F.col("canonical_path").alias("source_path"), F.posexplode("raw_imports").alias("seq", "i")).select("source_path", "seq", F.col("i.path").alias("spec"), F.col("i.line").alias("source_line"))
    hit = resolve.resolve(imports.select("source_path", "spec").distinct(), registry, aliases, packages)
    used = files.select(F.col("canonical_path").alias("source_path"), F.array_union("callsites", "ref_usages").alias("used"), "bindings", "names")
    target = files.select(F.col("canonical_path").alias("resolved"), F.coalesce(F.map_keys("exports"), F.array().cast("array<string>")).alias("exported"), F.col("exports").alias("lines"))
    j = imports.join(hit, ["source_path", "spec"]).where("source_path <> resolved").join(used, "source_path").join(target, "resolved")
    binding = F.try_element_at("bindings", F.col("spec"))
    named = F.coalesce(F.try_element_at("names", F.col("spec")), F.array().cast("array<string>"))
    local = F.array_compact(F.array_union(F.array(binding), named))
    live = F.array_intersect(local, "used")
    called = F.array_union(F.array_intersect("exported", "used"), F.filter(live, lambda x: ~(x == binding) | F.array_contains("exported", x)))
    j = j.withColumn("binding", F.coalesce(binding, F.lit(""))).withColumn("called_names", F.when(F.size(local) > 0, called).otherwise(F.array().cast("array<string>"))).withColumn("dead", (F.size(live) == 0) & (F.size("called_names") == 0))
    kind = fn.edge_class(F.col("source_path"), F.col("resolved"))
    ids = registry.select("node_id", "canonical_path")
    j = j.join(ids.toDF("source_id", "source_path"), "source_path").join(ids.toDF("target_id", "resolved"), "resolved")
    line = F.try_element_at("lines", F.get("called_names", F.lit(0)))
    return j.select("source_id", "target_id", F.when(kind == "RENDERS", 0.0).otherwise(1.0).alias("weight"), kind.alias("edge_type"), "binding", "called_names", F.col("dead").alias("is_dead_import"), F.lit(False).alias("is_synthetic"), "source_line", line.alias("target_line"), F.col("seq").cast("long").alias("seq"))


def inferred(raw: DataFrame, files: DataFrame, registry: DataFrame) -> DataFrame:
    """raw and what conventions, contracts and shared state add; each kind sees those before it."""
    last = lambda df, n: df.withColumn("seq", F.lit(n).cast("long")).withColumn("source_line", F.lit(None).cast("int") if "source_line" not in df.columns else F.col("source_line")).withColumn("target_line", F.lit(None).cast("int"))
    path = F.col("canonical_path")
    tiers = registry.select("node_id", fn.file_layer(path).alias("tier"), fn.domain_tokens(path).alias("tokens"))
    every = raw.unionByName(last(infer.synthetic(infer.naming_edges(tiers, raw), "BELONGS_TO_DOMAIN", S.CONVENTION_WEIGHT), 1 << 20))
    routed = registry.where(F.lower(fn.stem(path)).isin(*S.CONVENTION_STEMS)).select("node_id", fn.parent(path).alias("dir"), fn.stem(path).alias("stem"))
    layouts = infer.first_of_directory(routed.where(F.lower("stem").isin(*S.ROUTING_LAYOUTS)))
    pairs = infer.sibling_edges(routed.select("node_id", "dir")).unionByName(infer.layout_edges(routed.select("node_id", "dir"), layouts)).distinct().join(every.select(infer.PAIR), infer.PAIR, "left_anti")
    every = written(every.unionByName(last(infer.synthetic(pairs, "BELONGS_TO_DOMAIN", S.CONVENTION_WEIGHT), 2 << 20)), "edges")
    ids = registry.select("node_id", "canonical_path")
    by_path = every.select("source_id", "target_id").join(ids.toDF("source_id", "s"), "source_id").join(ids.toDF("target_id", "t"), "target_id").select(F.col("s").alias("source_id"), F.col("t").alias("target_id"))
    deps = files.withColumn("external_dependencies", packages_of(F.col("raw_imports")))
    found = infer.contract_edges(deps, bound(files, every, ids), by_path)
    found = found.toDF("s", "t", "edge_type", "called_names", "source_line").join(ids.toDF("source_id", "s"), "s").join(ids.toDF("target_id", "t"), "t")
    contracts = found.select("source_id", "target_id", F.lit(0.0).alias("weight"), "edge_type", F.lit("").alias("binding"), "called_names", F.lit(False).alias("is_dead_import"), F.lit(True).alias("is_synthetic"), F.col("source_line").cast("int").alias("source_line"))
    every = every.unionByName(last(contracts, 3 << 20))
    names = F.array_union("called_names", F.array("binding"))
    imports = every.where(F.col("edge_type").isin(*S.IMPORT_TYPES) & ~F.col("is_synthetic")).join(ids.toDF("target_id", "path"), "target_id")
    imports = imports.select("source_id", "target_id", fn.name(F.col("path")).alias("label"), F.exists(names, lambda n: n.rlike("(Provider|Context)$")).alias("provides"), F.exists(names, lambda n: n.rlike("^use[A-Z]")).alias("consumes"))
    state = infer.synthetic(infer.state_edges(imports, every).withColumn("called_names", F.array("label")), "PROVIDES_STATE", 0.0)
    return every.unionByName(last(state, 4 << 20))


def packages_of(imports):
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(imports, lambda i: fn.package(i["path"])))))


def bound(files: DataFrame, every: DataFrame, ids: DataFrame) -> DataFrame:
    """canonical_path, name, target: the file behind each imported name."""
    e = every.where("binding <> ''").join(ids.toDF("source_id", "canonical_path"), "source_id").join(ids.toDF("target_id", "target"), "target_id")
    return e.select("canonical_path", F.explode(F.array_union(F.array("binding"), "called_names")).alias("name"), "target").groupBy("canonical_path", "name").agg(F.min("target").alias("target"))


def analyze(spark: SparkSession, root: str, progress: Callable[[str, int], None] | None = None, embed: Callable[[list[str]], list[list[float]]] | None = None) -> Analysis:
    """Crawl, extract, resolve, infer, cluster, name and rank; admin files get a cluster of their own.

    embed gives texts their vectors; without it files are placed by edges and directories alone."""
    tell = progress or (lambda stage, percent: None)
    tell("crawl", 0)
    found = written(code.crawl(spark, root), "files")
    registry = written(code.registry(found), "registry")
    files = written(code.extracted(found), "extracted")
    tell("parse", 30)
    texts = code.configurations(spark, root)
    of = lambda *names: texts.where(fn.name(F.col("canonical_path")).isin(*names))
    aliases = code.path_aliases(of("tsconfig.json", "tsconfig.base.json", "jsconfig.json"))
    packages = code.workspace_packages(of("package.json"), of("pnpm-workspace.yaml"))
    every = written(inferred(raw_edges(files, registry, aliases, packages), files, registry), "edges")
    tell("cluster", 60)
    base = registry.join(files.select("canonical_path", packages_of(F.col("raw_imports")).alias("external_dependencies"), F.col("summary").alias("text_summary"), F.col("exports").alias("exported_names")), "canonical_path")
    admin = base.where(fn.is_admin(F.col("canonical_path")))
    app = base.where(~fn.is_admin(F.col("canonical_path")))
    app_edges = edges.between(every, app)
    merged = written(edges.boost_tests(edges.merge_edges(app_edges, ["seq"]), app), "merged")
    shared = written(edges.shared_dependencies(app, merged), "shared")
    rest, kept = edges.without_shared(app, merged)
    heads = written(edges.orchestrators(app, merged).select("node_id"), "heads")
    seeds = rest.join(heads, "node_id", "left_anti")
    vectors = None if embed is None else written(vec.embedded(base.select(F.col("node_id").alias("id"), F.col("text_summary").alias("text")), embed).withColumnRenamed("id", "node_id"), "vectors")
    # merge, split, give the heads a place, then absorb single nodes, also those that the split made
    members, merged_by = cluster.merged_small(cluster.adaptive_buckets(seeds), edges.between(kept, seeds), vectors=vectors)
    tree = written(cluster.split_buckets(members, kept), "tree")
    found, headed_by = cluster.reassigned(heads, cluster.leaves(tree).withColumnRenamed("cluster_id", "bucket"), vectors)
    found, absorbed_by = cluster.absorbed(written(found, "found"), kept, vectors)
    for placed_by in (merged_by, headed_by, absorbed_by):
        if placed_by is not None:
            every = written(every.unionByName(cluster.semantic_edges(placed_by, every).withColumn("seq", F.lit(5 << 20).cast("long")), allowMissingColumns=True), "edges")
    where = found.withColumnRenamed("bucket", "cluster_id").unionByName(shared.select("node_id", F.lit(S.INFRA_CLUSTERS[0]).alias("cluster_id"))).unionByName(admin.select("node_id", F.lit(S.INFRA_CLUSTERS[1]).alias("cluster_id")))
    placed = base.join(where, "node_id").join(shared.select("node_id", "is_god_file", "centrality_score", "execution_role"), "node_id", "left").na.fill(0.0, ["centrality_score"]).na.fill(False, ["is_god_file"])
    placed = written(placed.drop("execution_role").join(edges.local_roles(placed, merged).select("node_id", "execution_role"), "node_id"), "placed")
    tell("domains", 80)
    node_domains, cluster_domains = domains.detect(placed.withColumn("cluster_name", F.col("cluster_id")), app_edges)
    nodes = written(placed.join(node_domains.select("node_id", "domain", F.col("confidence").alias("domain_confidence"), F.col("source").alias("domain_source")), "node_id", "left"), "nodes")
    parents = tree.where("parent_id is not null").select("cluster_id", "parent_id").distinct()
    sizes = nodes.groupBy("cluster_id").agg(F.count("*").alias("size"))
    clusters = written(sizes.join(parents, "cluster_id", "left").join(cluster_domains.select("cluster_id", F.col("domain").alias("cluster_domain"), "kind"), "cluster_id", "left").join(analytics.auto_titles(nodes), "cluster_id", "left"), "clusters")
    flat = written(edges.flattened(every, registry, ["seq"]).join(every.groupBy("source_id", "target_id").agg(F.bool_and("is_synthetic").alias("is_synthetic")).join(registry.toDF("source_id", "source"), "source_id").join(registry.toDF("target_id", "target"), "target_id").select("source", "target", "is_synthetic"), ["source", "target"]), "flat")
    entries = written(analytics.entry_points(nodes, flat), "entries")
    tell("done", 100)
    return Analysis(nodes, flat, clusters, entries, analytics.coverage(nodes, flat, entries))
