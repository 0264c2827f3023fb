"""Queries on graphs: merge, roles, metrics, reach, propagation, components, domains, clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica import schemas as S
from lattica.functions import scalar as fn
from lattica.operators import analytics, cluster, communities, domains, edges, graph, infer, metrics, reach, vectors
from lattica.plans import views as v
from lattica.plans.registry import query

R4 = "floor({} * 10000 + 0.5) / 10000"


@query("SELECT source_id, target_id, edge_type, CASE WHEN edge_type = 'RENDERS' THEN 0.0::DOUBLE ELSE total END AS weight, called_names, binding, is_dead_import, is_synthetic, source_line FROM merged", "edges_raw merged")
def edge_merge(t):
    return edges.merge_edges(v.edges_raw(t), v.ORDER).withColumn("called_names", F.array_join("called_names", ",")).drop("target_line")


_METRICS = """, e AS (SELECT source_id, target_id, sum(weight) AS w FROM edges_raw WHERE weight > 0 GROUP BY 1, 2),
s AS (SELECT 'before' AS scenario, node_id, cluster_id FROM nodes {after}),
p AS (SELECT a.scenario, a.cluster_id AS sc, b.cluster_id AS tc, sum(w) AS w FROM e JOIN s a ON source_id = a.node_id JOIN s b ON target_id = b.node_id AND a.scenario = b.scenario GROUP BY 1, 2, 3),
d AS (SELECT scenario, c, sum(deg) AS deg, sum(ins) AS ins FROM (SELECT scenario, sc AS c, w AS deg, CASE WHEN sc = tc THEN w ELSE 0 END AS ins FROM p UNION ALL SELECT scenario, tc, w, 0 FROM p) GROUP BY 1, 2),
z AS (SELECT scenario, cluster_id, count(*) AS n FROM s GROUP BY 1, 2),
m AS (SELECT z.scenario, coalesce(sum(deg), 0) / 2 AS tw, coalesce(sum(ins), 0) AS iw, coalesce(sum(deg * deg), 0) AS sq, count(*) AS k, sum(n) AS n, sum(n * ln(n)) AS pl FROM z LEFT JOIN d ON z.scenario = d.scenario AND cluster_id = c GROUP BY 1),
q AS (SELECT scenario, iw / tw - sq / (4 * tw * tw) AS modularity, iw / tw * 100 AS cohesion, (tw - iw) / tw * 100 AS coupling, (ln(n) - pl / n) / ln(k) * 100 AS size_balance FROM m),
g AS (SELECT *, 55 * (greatest(-1, least(1, modularity)) + 1) / 2 + 0.35 * cohesion + 0.10 * size_balance AS graph_score FROM q)
"""


@query(_METRICS.format(after="") + "SELECT " + ", ".join(f"{R4.format(c)} AS {c}" for c in ("modularity", "cohesion", "coupling", "size_balance", "graph_score")) + " FROM g", "edges_raw nodes")
def partition_metrics(t):
    found = metrics.partition_metrics(v.nodes(t), v.edges_raw(t))
    return found.select(*(fn.half_up(F.col(c), 4).alias(c) for c in ("modularity", "cohesion", "coupling", "size_balance", "graph_score")))


_SIDES = [f"{c}_{s}" for c in ("modularity", "cohesion", "coupling", "size_balance", "placement", "quality") for s in ("before", "after")]


@query(
    _METRICS.format(after="UNION ALL SELECT 'after', node_id, CASE WHEN node_id = 'p1' THEN 'N7' ELSE cluster_id END FROM nodes")
    + """, f AS (SELECT s.scenario, sum(CASE WHEN s.cluster_id = own.cluster_id THEN w ELSE 0 END) / sum(w) * 100 AS placement FROM e JOIN s ON s.node_id = target_id JOIN s own ON own.node_id = 'p1' AND own.scenario = s.scenario WHERE source_id = 'p1' GROUP BY 1),
h AS (SELECT g.*, coalesce(placement, 0) AS placement, CASE WHEN placement IS NULL THEN graph_score ELSE 0.75 * graph_score + 0.25 * placement END AS quality FROM g LEFT JOIN f USING (scenario)),
x AS (SELECT """
    + ", ".join(f"max({c.rsplit('_', 1)[0]}) FILTER (scenario = '{c.rsplit('_', 1)[1]}') AS {c}" for c in _SIDES)
    + " FROM h) SELECT "
    + ", ".join(f"{R4.format(c)} AS {c}" for c in _SIDES)
    + ", " + ", ".join(f"{R4.format(f'({c}_after - {c}_before)')} AS {c}_delta" for c in ("modularity", "cohesion", "coupling", "size_balance", "placement", "quality"))
    + """, (SELECT cluster_id FROM nodes WHERE node_id = 'p1') AS from_cluster, (SELECT count(*) FROM nodes WHERE cluster_id = (SELECT cluster_id FROM nodes WHERE node_id = 'p1'))::BIGINT AS source_before, (SELECT count(*) - 1 FROM nodes WHERE cluster_id = (SELECT cluster_id FROM nodes WHERE node_id = 'p1'))::BIGINT AS source_after,
(SELECT count(*) FROM nodes WHERE cluster_id = 'N7')::BIGINT AS target_before, (SELECT count(*) + 1 FROM nodes WHERE cluster_id = 'N7')::BIGINT AS target_after"""
    + ", CASE WHEN quality_after - quality_before > 0.1 THEN 'IMPROVES' WHEN quality_after - quality_before < -0.1 THEN 'WORSENS' ELSE 'NEUTRAL' END AS verdict, concat_ws(',', CASE WHEN (SELECT count(*) FROM f) = 0 THEN 'placement:none' ELSE "
    + ", ".join(f"'{c}:' || CASE WHEN {c}_after >= {c}_before THEN 'up' ELSE 'down' END" + (" END" if c == "placement" else "") for c in ("placement", "modularity", "cohesion"))
    + ", CASE WHEN abs(size_balance_after - size_balance_before) >= 0.01 THEN 'size_balance:' || CASE WHEN size_balance_after >= size_balance_before THEN 'up' ELSE 'down' END END) AS reasons FROM x",
    "edges_raw nodes",
)
def move_preview(t):
    found = metrics.move_preview(v.nodes(t), v.edges_raw(t), "p1", "N7")
    return found.withColumn("reasons", F.array_join(F.transform("reasons", lambda r: F.concat(r["measure"], F.lit(":"), r["direction"])), ","))


_DEGREES = """, u AS (SELECT node_id, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o FROM (SELECT source_id AS node_id, 0 AS i, 1 AS o FROM {e} UNION ALL SELECT target_id, 1, 0 FROM {e}) GROUP BY 1),
deg AS (SELECT node_id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM {n} LEFT JOIN u USING (node_id))"""
_ROLE = "CASE WHEN in_degree = 0 AND out_degree > 0 THEN 'ENTRY_POINT' WHEN out_degree = 0 AND in_degree > 0 THEN 'TERMINAL_SINK' ELSE 'INTERNAL' END AS execution_role"


@query(", used AS (SELECT * FROM merged WHERE edge_type <> 'CALLS_API')" + _DEGREES.format(e="used", n="nodes") + f" SELECT node_id, in_degree, out_degree, {_ROLE} FROM deg", "edges_raw nodes merged")
def degrees_roles(t):
    return edges.roles(v.nodes(t), edges.merge_edges(v.edges_raw(t), v.ORDER))


@query(", used AS (SELECT m.* FROM merged m JOIN nodes a ON source_id = a.node_id JOIN nodes b ON target_id = b.node_id WHERE a.cluster_id = b.cluster_id AND edge_type <> 'CALLS_API')" + _DEGREES.format(e="used", n="nodes") + f" SELECT node_id, in_degree, out_degree, {_ROLE} FROM deg", "edges_raw nodes merged")
def local_roles(t):
    return edges.local_roles(v.nodes(t), edges.merge_edges(v.edges_raw(t), v.ORDER))


_STAR = """SELECT 'c' || c_custkey AS source_id, 'n' || c_nationkey AS target_id FROM customer UNION ALL SELECT 'c' || c_custkey, 'm' || c_mktsegment FROM customer"""


def _star(t):
    c = F.concat(F.lit("c"), "c_custkey").alias("source_id")
    e = t.customer.select(c, F.concat(F.lit("n"), "c_nationkey").alias("target_id")).unionByName(t.customer.select(c, F.concat(F.lit("m"), "c_mktsegment").alias("target_id"))).withColumn("edge_type", F.lit("BELONGS_TO_DOMAIN"))
    return e.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct(), e


@query(f"WITH e AS ({_STAR}), n AS (SELECT DISTINCT unnest([source_id, target_id]) AS node_id FROM e)" + _DEGREES.format(e="e", n="n") + f", c AS (SELECT count(*) AS k FROM n) SELECT node_id, 'SHARED_DEPENDENCY' AS execution_role, true AS is_god_file, {R4.format('(in_degree / k)')} AS centrality_score FROM deg, c WHERE out_degree = 0 AND in_degree / k > 0.10")
def shared_dependencies(t):
    return edges.shared_dependencies(*_star(t))


@query("""WITH e AS (SELECT DISTINCT o_orderpriority AS source_id, 'c' || (o_custkey % 200) AS target_id FROM orders), n AS (SELECT DISTINCT unnest([source_id, target_id]) AS node_id FROM e), c AS (SELECT count(*) AS k FROM n),
i AS (SELECT target_id, count(*) AS d FROM e GROUP BY 1), shared AS (SELECT target_id AS node_id FROM i, c WHERE d / k > 0.10 AND target_id NOT IN (SELECT source_id FROM e)),
e2 AS (SELECT * FROM e WHERE target_id NOT IN (SELECT node_id FROM shared)), n2 AS (SELECT count(*) AS k FROM n WHERE node_id NOT IN (SELECT node_id FROM shared))
SELECT source_id AS node_id, count(*)::BIGINT AS out_degree FROM e2, n2 WHERE source_id NOT IN (SELECT target_id FROM e2) GROUP BY source_id, k HAVING count(*) / k > 0.15""")
def orchestrators(t):
    e = t.orders.select(F.col("o_orderpriority").alias("source_id"), F.concat(F.lit("c"), F.col("o_custkey") % 200).alias("target_id"), F.lit("BELONGS_TO_DOMAIN").alias("edge_type")).distinct()
    return edges.orchestrators(e.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct(), e)


@query("SELECT source_id, target_id, CASE WHEN regexp_matches(p.path, '(?i)(^|/)(tests?|__tests__|spec)(/|$)|\\.(test|spec)\\.(js|ts|jsx|tsx|mjs)$') THEN 50.0::DOUBLE ELSE total END AS weight FROM merged JOIN (SELECT 'p' || p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'src/tests/' || p_partkey || '.ts' ELSE 'src/' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '.spec.ts' ELSE '.ts' END END AS path FROM part) p ON source_id = p.id", "edges_raw merged")
def test_edge_boost(t):
    k = F.col("p_partkey")
    path = F.when(k % 7 == 0, F.concat(F.lit("src/tests/"), k, F.lit(".ts"))).otherwise(F.concat(F.lit("src/"), k, F.when(k % 5 == 0, ".spec.ts").otherwise(".ts")))
    p = t.part.select(F.concat(F.lit("p"), k).alias("node_id"), path.alias("canonical_path"))
    summed = v.edges_raw(t).groupBy("source_id", "target_id").agg(F.sum("weight").alias("weight"))
    return edges.boost_tests(summed, p).select("source_id", "target_id", "weight")


@query("SELECT source_id, target_id, edge_type, CASE WHEN edge_type = 'RENDERS' THEN 0.0::DOUBLE ELSE total END AS weight FROM merged WHERE edge_type NOT IN ('RENDERS', 'CALLS_API') AND total > 0", "edges_raw merged")
def structural_filter(t):
    m = edges.merge_edges(v.edges_raw(t), v.ORDER)
    return m.where(edges.is_structural(F.col("edge_type"), F.col("weight"))).select("source_id", "target_id", "edge_type", "weight")


@query("SELECT edge_type, is_synthetic, count(*)::BIGINT AS n FROM edges_raw WHERE edge_type = 'CALLS_API' OR NOT is_synthetic GROUP BY 1, 2", "edges_raw")
def journey_filter(t):
    return v.edges_raw(t).where(edges.is_journey(F.col("edge_type"), F.col("is_synthetic"))).groupBy("edge_type", "is_synthetic").agg(F.count("*").alias("n"))


@query("SELECT source_id, target_id, count(*)::BIGINT AS n FROM edges_raw WHERE source_id IN (SELECT node_id FROM nodes WHERE cluster_id IN ('N1', 'N2', 'N3', 'N4', 'N5')) AND target_id IN (SELECT node_id FROM nodes WHERE cluster_id IN ('N1', 'N2', 'N3', 'N4', 'N5')) GROUP BY 1, 2", "edges_raw nodes")
def app_edges(t):
    app = v.nodes(t).where(F.col("cluster_id").isin("N1", "N2", "N3", "N4", "N5"))
    return edges.between(v.edges_raw(t), app).groupBy("source_id", "target_id").agg(F.count("*").alias("n"))


@query(f"SELECT a.canonical_path AS source, b.canonical_path AS target, type, {R4.format('w')} AS weight FROM (SELECT source_id, target_id, arg_min(edge_type, o) AS type, arg_min(weight, o) AS w FROM edges_raw GROUP BY 1, 2) JOIN (SELECT 'p' || node_id AS id, canonical_path FROM paths) a ON source_id = a.id JOIN (SELECT 's' || s_suppkey AS id, 'lib/' || s_name AS canonical_path FROM supplier WHERE s_acctbal > 0) b ON target_id = b.id", "edges_raw paths")
def flattened_edges(t):
    p = v.paths(t).select(F.concat(F.lit("p"), "node_id").alias("node_id"), "canonical_path")
    s = t.supplier.where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.concat(F.lit("lib/"), "s_name").alias("canonical_path"))
    return edges.flattened(v.edges_raw(t), p.unionByName(s), v.ORDER)


@query(", e AS (SELECT DISTINCT source_id, target_id, a.cluster_id AS sc, b.cluster_id AS tc FROM edges_raw JOIN nodes a ON source_id = a.node_id JOIN nodes b ON target_id = b.node_id) SELECT cluster_id, (SELECT count(*) FROM nodes n WHERE n.cluster_id = c.cluster_id)::BIGINT AS size, (SELECT count(*) FROM e WHERE sc = cluster_id AND tc = cluster_id)::BIGINT AS internal, (SELECT count(*) FROM e WHERE sc = cluster_id AND tc <> cluster_id)::BIGINT AS outgoing, (SELECT count(*) FROM e WHERE sc <> cluster_id AND tc = cluster_id)::BIGINT AS incoming FROM (SELECT DISTINCT cluster_id FROM nodes) c", "edges_raw nodes")
def cluster_edge_counts(t):
    return analytics.cluster_edge_counts(v.nodes(t), v.edges_raw(t))


_COHESION = ", l AS (SELECT DISTINCT unnest([source_id, target_id]) AS node_id FROM edges_raw JOIN nodes a ON source_id = a.node_id JOIN nodes b ON target_id = b.node_id WHERE a.cluster_id = b.cluster_id), c AS (SELECT cluster_id, count(*)::BIGINT AS size, count(l.node_id)::BIGINT AS topological, (count(*) - count(l.node_id))::BIGINT AS semantic FROM nodes n LEFT JOIN l ON n.node_id = l.node_id GROUP BY 1), b AS (SELECT *, CASE WHEN size = 1 THEN 'singleton' WHEN topological >= semantic THEN 'topological' ELSE 'semantic_blob' END AS basis FROM c) "


@query(_COHESION + "SELECT * FROM b", "edges_raw nodes")
def cohesion_basis(t):
    return analytics.cohesion(v.nodes(t), v.edges_raw(t))


@query(_COHESION + "SELECT max(size) AS size, arg_min(cluster_id, (-size, cluster_id)) AS cluster_id, count(*) FILTER (size = 1)::BIGINT AS singletons, count(*) FILTER (basis = 'semantic_blob')::BIGINT AS semantic_blobs, CASE WHEN count(*) FILTER (size = 1) > 8 THEN 'singletons' WHEN count(*) FILTER (basis = 'semantic_blob') > 2 THEN 'semantic blobs' ELSE 'large cluster' END AS cause FROM b HAVING max(size) > 15 OR count(*) FILTER (size = 1) > 8 OR count(*) FILTER (basis = 'semantic_blob') > 2", "edges_raw nodes")
def root_cause(t):
    return analytics.root_cause(analytics.cohesion(v.nodes(t), v.edges_raw(t)), 1)


@query("SELECT min(n) AS min_size, max(n) AS max_size, floor(avg(n) * 10 + 0.5) / 10 AS avg_size, count(*) FILTER (n = 1)::BIGINT AS singletons, count(*) FILTER (n > 15)::BIGINT AS large_clusters, arg_min(cluster_id, (-n, cluster_id)) AS largest FROM (SELECT cluster_id, count(*)::BIGINT AS n FROM nodes GROUP BY 1)", "nodes")
def size_stats(t):
    return analytics.size_stats(v.nodes(t))


@query(", d AS (SELECT 'N' || (node_id % 25) AS cluster_id, regexp_replace(canonical_path, '/[^/]*$', '') AS dir, count(*)::BIGINT AS files FROM paths GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY files DESC, dir) = 1 AS is_primary FROM d", "paths")
def directory_histogram(t):
    return analytics.directory_histogram(v.paths(t).select(F.concat(F.lit("N"), F.col("node_id") % 25).alias("cluster_id"), "canonical_path"))


@query(", s AS (SELECT source_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY total DESC, target_id) AS r FROM merged) SELECT source_id, string_agg(target_id, ',' ORDER BY r) AS targets FROM s WHERE r <= 3 GROUP BY 1", "edges_raw merged")
def top_neighbours(t):
    return analytics.top_neighbours(v.edges_raw(t).groupBy("source_id", "target_id").agg(F.sum("weight").alias("weight")))


@query(", s AS (SELECT source_id, target_id, row_number() OVER (PARTITION BY target_id ORDER BY total DESC, source_id) AS r FROM merged) SELECT target_id, string_agg(source_id, ',' ORDER BY r) AS sources FROM s WHERE r <= 3 GROUP BY 1", "edges_raw merged")
def top_sources(t):
    return analytics.top_neighbours(v.edges_raw(t).groupBy("source_id", "target_id").agg(F.sum("weight").alias("weight")), incoming=True)


_FILES = "SELECT 'N' || (node_id % 25) AS cluster_id, canonical_path, row_number() OVER (PARTITION BY node_id % 25 ORDER BY p_retailprice DESC, canonical_path)::INTEGER AS rank FROM paths"


def _central(t):
    return v.paths(t).select(F.concat(F.lit("N"), F.col("node_id") % 25).alias("cluster_id"), "canonical_path", F.col("p_retailprice").alias("centrality_score"))


@query(f", f AS ({_FILES}) SELECT * FROM f WHERE rank <= 5", "paths")
def top_members(t):
    return analytics.top_members(_central(t))


@query(f", f AS ({_FILES}), d AS (SELECT cluster_id, string_split(canonical_path, '/')[-2] AS dir, count(*) AS n FROM f WHERE rank <= 5 GROUP BY 1, 2) SELECT cluster_id, upper(x[1]) || lower(x[2:]) || ' Module' AS title FROM (SELECT cluster_id, replace(arg_min(dir, (-n, dir)), '#', '#') AS x FROM d GROUP BY 1)", "paths")
def auto_title(t):
    return analytics.auto_titles(_central(t).withColumn("canonical_path", F.regexp_replace("canonical_path", "-", "-")))


@query("SELECT node_id, cluster_id, ((row_number() OVER (PARTITION BY cluster_id ORDER BY node_id) - 1) // 30)::BIGINT AS chunk FROM nodes", "nodes")
def even_chunks(t):
    return analytics.chunks(v.nodes(t), ["cluster_id"], ["node_id"], 30)


@query("SELECT cluster_id, ((row_number() OVER (PARTITION BY left(cluster_id, 1) ORDER BY cluster_id) - 1) // 8)::BIGINT AS chunk FROM (SELECT DISTINCT cluster_id FROM nodes)", "nodes")
def batch_ids(t):
    c = v.nodes(t).select("cluster_id").distinct().withColumn("kind", F.substring("cluster_id", 1, 1))
    return analytics.chunks(c, ["kind"], ["cluster_id"], 8).drop("kind")


_REACH = ", reach(node) AS (SELECT min(src) FROM digraph UNION SELECT dst FROM digraph JOIN reach ON src = node)"


@query(_REACH + " SELECT node FROM reach", "digraph")
def bfs_reach(t):
    e = v.digraph(t)
    return graph.reachable(e, e.agg(F.min("src").alias("root"))).select("node")


@query(", reach(root, node) AS (SELECT DISTINCT src, src FROM digraph UNION SELECT root, dst FROM digraph JOIN reach ON src = node) SELECT root, count(*)::BIGINT AS reached FROM reach GROUP BY 1", "digraph")
def multi_source_coverage(t):
    """How many nodes each source reaches."""
    e = v.digraph(t)
    return reach.reach_counts(reach.reach_sets(e), e.select(F.col("src").alias("root")))


_PAIRS = ", reach(root, node) AS (SELECT src, src FROM digraph UNION SELECT dst, dst FROM digraph UNION SELECT root, dst FROM digraph JOIN reach ON src = node)"


@query(_PAIRS + " SELECT a.root AS node, max(a.node) AS component FROM reach a JOIN reach b ON a.root = b.node AND a.node = b.root GROUP BY 1", "digraph")
def strong_components(t):
    """Nodes that reach each other, named by the greatest of them."""
    found = reach.strong_components(v.digraph(t))
    return found.select("node", F.max("node").over(Window.partitionBy("component")).alias("component"))


@query(_REACH + ", n AS (SELECT src AS node FROM digraph UNION SELECT dst FROM digraph) SELECT count(*)::BIGINT AS unreached, coalesce(string_agg(node, ',' ORDER BY node) FILTER (r <= 50), '') AS sample FROM (SELECT node, row_number() OVER (ORDER BY node) AS r FROM n WHERE node NOT IN (SELECT node FROM reach))", "digraph")
def unreached(t):
    e = v.digraph(t)
    n = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    found = analytics.unreached(n, graph.reachable(e, e.agg(F.min("src").alias("root"))).select("node"))
    return found.select(F.col("unreached_count").alias("unreached"), F.array_join(F.col("unreached_sample").cast("array<string>"), ",").alias("sample"))


@query(", b AS (SELECT src AS x, dst AS y FROM digraph UNION SELECT dst, src FROM digraph), reach(a, b) AS (SELECT x, x FROM b UNION SELECT a, y FROM reach JOIN b ON reach.b = b.x) SELECT a AS node, min(b) AS component FROM reach WHERE a IN (SELECT x FROM b WHERE x <> y) GROUP BY 1", "digraph")
def weak_components(t):
    return graph.connected_components(v.digraph(t))


_ROUND = "r{n} AS (SELECT node, domain, sum(score)::DOUBLE AS score FROM (SELECT l.dst AS node, p.domain, 0.85 * l.share * p.score AS score FROM links l JOIN r{p} p ON l.src = p.node WHERE l.dst NOT IN (SELECT node FROM seed) UNION ALL SELECT node, domain, score FROM seed) GROUP BY 1, 2)"
_SEEDS = ", seed AS (SELECT DISTINCT src AS node, 'D' || (src % 3) AS domain, (0.65 + 0.1 * (src % 3))::DOUBLE AS score FROM digraph WHERE src % 7 = 0), b AS (SELECT src, dst, 1.0::DOUBLE AS w FROM digraph WHERE src <> dst UNION ALL SELECT dst, src, 1.0 FROM digraph WHERE src <> dst), s AS (SELECT src, dst, sum(w) AS w FROM b GROUP BY 1, 2), links AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY dst) AS share FROM s), r0 AS (SELECT * FROM seed), " + ", ".join(_ROUND.format(n=i, p=i - 1) for i in (1, 2, 3))


def _seeds(t):
    s = v.digraph(t).where("src % 7 = 0").select(F.col("src").alias("node")).distinct()
    return s.select("node", F.concat(F.lit("D"), F.col("node") % 3).alias("domain"), (0.65 + 0.1 * (F.col("node") % 3)).cast("double").alias("score"))


@query(_SEEDS + f" SELECT node, domain, {R4.format('(score + 1e-9)')} AS score FROM r3", "digraph")
def label_propagation_rounds(t):
    found = graph.propagate_rounds(v.digraph(t).withColumn("weight", F.lit(1.0)), _seeds(t), 3, 0.85)
    return found.select("node", "domain", fn.half_up(F.col("score") + 1e-9, 4).alias("score"))  # off the exact halves, where sums in another order differ


@query()
def label_propagation(t):
    """All rounds until scores settle; their number depends on the data."""
    return graph.propagate(v.digraph(t).withColumn("weight", F.lit(1.0)), _seeds(t), 30, 0.85, 1e-4)


@query(_SEEDS + ", k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, domain) AS r, lead(score) OVER (PARTITION BY node ORDER BY score DESC, domain) AS second FROM (SELECT node, domain, floor(score * 1000000 + 0.5) / 1000000 AS score FROM r3)) SELECT node, domain, floor(least(0.95, score) * 100 + 0.5) / 100 AS confidence FROM k WHERE r = 1 AND score >= 0.15 AND coalesce(second, 0) * 1.5 <= score", "digraph")
def node_classify(t):
    found = graph.propagate_rounds(v.digraph(t).withColumn("weight", F.lit(1.0)), _seeds(t), 3, 0.85)
    return domains.classify(found.withColumn("score", fn.half_up(F.col("score"), 6)))


@query("""WITH m AS (SELECT c_nationkey AS cluster_id, CASE WHEN c_custkey % 5 < 3 THEN 'D' || (c_nationkey % 4) WHEN c_custkey % 5 = 3 THEN c_mktsegment END AS domain, floor(abs(c_acctbal) / 100) / 100 AS confidence FROM customer),
z AS (SELECT cluster_id, count(*)::BIGINT AS members FROM m GROUP BY 1), p AS (SELECT cluster_id, domain, count(*)::BIGINT AS files, avg(confidence) AS mean FROM m WHERE domain IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY files DESC, domain) AS r, coalesce(lead(files) OVER (PARTITION BY cluster_id ORDER BY files DESC, domain), 0) AS second FROM p)
SELECT cluster_id, domain, files, members, floor(least(0.95, files / members * mean) * 100 + 0.5) / 100 AS confidence FROM r JOIN z USING (cluster_id) WHERE r = 1 AND files / members >= 0.4 AND files >= 1.5 * second""")
def cluster_domain(t):
    k = F.col("c_custkey") % 5
    domain = F.when(k < 3, F.concat(F.lit("D"), F.col("c_nationkey") % 4)).when(k == 3, F.col("c_mktsegment"))
    m = t.customer.select(F.col("c_nationkey").alias("cluster_id"), domain.alias("domain"), (F.floor(F.abs("c_acctbal") / 100) / 100).alias("confidence"))
    return domains.cluster_domains(m)


@query(f", n AS (SELECT sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l, * FROM vec) SELECT a.id AS a, b.id AS b, {R4.format('(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / (a.l * b.l))')} AS similarity FROM n a JOIN n b ON a.grp = b.grp AND b.id = a.id + 10", "vec")
def cosine_pairs(t):
    a = v.vectors(t)
    b = a.select(F.col("id").alias("b"), "grp", F.col("v").alias("w"))
    return a.join(b, "grp").where("b = id + 10").select(F.col("id").alias("a"), "b", fn.half_up(fn.cosine(F.col("v"), F.col("w")), 4).alias("similarity"))


_CENTERS = ", c AS (SELECT grp, list(x ORDER BY i) AS center FROM (SELECT grp, i, avg(v[i]) AS x FROM (SELECT grp, v, unnest(range(1, len(v) + 1)) AS i FROM vec) GROUP BY 1, 2) GROUP BY 1)"


@query(_CENTERS + f" SELECT grp, len(center) AS dims, {R4.format('list_sum(center)')} AS total FROM c", "vec")
def centroids(t):
    return vectors.centroids(v.vectors(t), "grp").select("grp", F.size("centroid").cast("long").alias("dims"), fn.half_up(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform({a}, lambda x: x * x))) * sqrt(list_sum(list_transform({b}, lambda x: x * x))))"


@query(_CENTERS + f", s AS (SELECT id, c.grp AS best, {_COS.format(a='v', b='center')} AS s FROM vec, c) SELECT id, arg_max(best, (s, -best)) AS best, {R4.format('max(s)')} AS similarity FROM s GROUP BY 1", "vec")
def nearest_centroid(t):
    return vectors.nearest_centroid(v.vectors(t), vectors.centroids(v.vectors(t), "grp"), "grp").withColumn("similarity", fn.half_up(F.col("similarity"), 4))


@query(f", s AS (SELECT a.id, b.id AS best, {_COS.format(a='a.v', b='b.v')} AS s FROM vec a JOIN vec b ON a.grp = b.grp AND a.id <> b.id) SELECT id, arg_max(best, (s, -best)) AS best, {R4.format('max(s)')} AS similarity FROM s GROUP BY 1", "vec")
def nearest_member(t):
    return vectors.nearest_member(v.vectors(t), v.vectors(t)).withColumn("similarity", fn.half_up(F.col("similarity"), 4))


def _supply(t):
    """Parts and suppliers with numbers as node ids, bucketed by cluster."""
    b = v.nodes(t).withColumnRenamed("cluster_id", "bucket")
    return b, v.edges_raw(t).withColumn("edge_type", F.lit("BELONGS_TO_DOMAIN"))


@query(" SELECT count(*)::BIGINT AS nodes, true AS once, true AS no_less_than_directories FROM nodes", "nodes")
def community_rounds(t):
    """Communities of the whole graph by rounds over all workers: each node once, modularity no less than that of the clusters."""
    n = v.nodes(t)
    e = v.edges_raw(t).where("weight > 0").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("weight").alias("w"))
    start = n.select(F.col("node_id").alias("node"), F.col("cluster_id").alias("community"))
    found, reached, known = communities.compared(n.select(F.col("node_id").alias("node")), e, start=start)
    better = reached >= known - 1e-9
    whole = n.join(found.groupBy(F.col("node").alias("node_id")).agg(F.count("*").alias("times")), "node_id", "left")
    return whole.agg(F.count("*").alias("nodes"), (F.max(F.coalesce("times", F.lit(0))) == 1).alias("once")).select("nodes", F.coalesce("once", F.lit(True)).alias("once"), F.lit(better).alias("no_less_than_directories"))


@query(" SELECT cluster_id AS bucket, count(*)::BIGINT AS nodes, count(*)::BIGINT AS placed, true AS once, true AS small, true AS nested FROM nodes GROUP BY 1", "nodes")
def split_contract(t):
    """What a split must keep: every node of a bucket in one leaf, leaves of 30 at most, parents that stand."""
    b, e = _supply(t)
    rows = cluster.split_buckets(b, e)
    leaves = rows.where("is_leaf").groupBy("node_id").agg(F.count("*").alias("times"), F.min("cluster_id").alias("leaf"))
    sizes = rows.where("is_leaf").groupBy(F.col("cluster_id").alias("leaf")).agg(F.count("*").alias("size"))
    held = b.join(leaves, "node_id", "left").join(sizes, "leaf", "left")
    under = (F.col("leaf") == F.col("bucket")) | F.col("leaf").startswith(F.concat("bucket", F.lit(".")))
    return held.groupBy("bucket").agg(F.count("*").alias("nodes"), F.count("leaf").alias("placed"), (F.max("times") == 1).alias("once"), (F.max("size") <= 30).alias("small"), F.bool_and(under).alias("nested"))


@query()
def louvain_split(t):
    return cluster.split_buckets(*_supply(t))


_JOINED = ", e AS (SELECT target_id AS s, 'x/' || n.cluster_id AS b, sum(weight) AS w FROM edges_raw JOIN nodes n ON source_id = n.node_id WHERE weight > 0 GROUP BY 1, 2), z AS (SELECT 'x/' || cluster_id AS b, count(*) AS n FROM nodes WHERE node_id LIKE 'p%' GROUP BY 1), c AS (SELECT s, arg_min(e.b, (-w, e.b)) AS b FROM e JOIN z USING (b) WHERE n > 1 GROUP BY 1) SELECT node_id, CASE WHEN node_id LIKE 'p%' THEN 'x/' || cluster_id ELSE coalesce(c.b, 'x/' || node_id) END AS bucket FROM nodes LEFT JOIN c ON node_id = s"


@query(_JOINED, "edges_raw nodes")
def merge_small(t):
    b, e = _supply(t)
    return cluster.merge_small(b.withColumn("bucket", F.when(F.col("node_id").startswith("s"), F.concat(F.lit("x/"), "node_id")).otherwise(F.concat(F.lit("x/"), "bucket"))), e)


@query(_JOINED, "edges_raw nodes")
def absorb_singletons(t):
    b, e = _supply(t)
    return cluster.absorb_singletons(b.withColumn("bucket", F.when(F.col("node_id").startswith("s"), F.concat(F.lit("x/"), "node_id")).otherwise(F.concat(F.lit("x/"), "bucket"))), e)


@query("WITH imports AS (SELECT 'p' || l_partkey AS source_id, 'o' || (l_orderkey // 8) AS target_id, l_linenumber FROM lineitem), m AS (SELECT target_id, count(*) FILTER (l_linenumber = 1) AS p, count(*) FILTER (l_linenumber = 2) AS c FROM imports GROUP BY 1), f AS (SELECT target_id FROM m WHERE p > 0 AND c > 0 AND p * c <= 150) SELECT a.source_id, b.source_id AS target_id, min(a.target_id) AS label FROM imports a JOIN imports b ON a.target_id = b.target_id JOIN f ON f.target_id = a.target_id WHERE a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.source_id <> b.source_id GROUP BY 1, 2")
def state_edges(t):
    n = F.col("l_linenumber")
    module = F.concat(F.lit("o"), F.call_function("div", F.col("l_orderkey"), F.lit(8)))
    imports = t.lineitem.select(F.concat(F.lit("p"), "l_partkey").alias("source_id"), module.alias("target_id"), module.alias("label"), (n == 1).alias("provides"), (n == 2).alias("consumes"))
    return infer.state_edges(imports, v.edges_raw(t))


_ALONE = """, d AS (SELECT n.node_id, p_partkey, (SELECT count(*) FROM edges_raw e WHERE e.source_id = n.node_id) AS o FROM nodes n JOIN part ON n.node_id = 'p' || p_partkey WHERE p_partkey % 5 = 0),
f AS (SELECT ['next-page/layout', 'hook', 'style'][1 + p_partkey % 3] AS category, CASE WHEN o = 0 THEN 'isolated' ELSE 'entry-only' END AS degree, CASE WHEN o = 0 THEN 'INTERNAL' ELSE 'ENTRY_POINT' END AS role FROM d),
g AS (SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(degree) = 0 THEN 'degree' WHEN grouping(role) = 0 THEN 'role' ELSE 'all' END AS dimension, coalesce(category, degree, role) AS value, count(*) AS files FROM f GROUP BY GROUPING SETS ((category), (degree), (role), ()))
SELECT dimension, value, files::BIGINT AS files, floor(files * 1000.0::DOUBLE / (SELECT count(*) FROM f) + 0.5) / 10 AS share FROM g WHERE files > 0"""


@query(_ALONE, "nodes edges_raw")
def singleton_diagnostics(t):
    """Every fifth part as a cluster of one file: what kinds of files stay alone."""
    k = F.col("p_partkey") % 3
    path = F.when(k == 0, "w/page.tsx").when(k == 1, "w/hooks/a.js").otherwise("w/z.css")
    alone = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("c"), "p_partkey")).otherwise("rest")
    files = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), path.alias("canonical_path"), alone.alias("cluster_id"))
    return analytics.singleton_diagnostics(files, v.edges_raw(t)).where("files > 0")


@query(" SELECT CASE WHEN grouping(category) = 0 THEN 'category' ELSE 'all' END AS dimension, category AS value, count(*)::BIGINT AS files, floor(count(*) * 1000.0::DOUBLE / (SELECT count(*) FROM part WHERE p_partkey % 4 = 0) + 0.5) / 10 AS share FROM (SELECT ['next-page/layout', 'hook', 'style'][1 + p_partkey % 3] AS category FROM part WHERE p_partkey % 4 = 0) GROUP BY GROUPING SETS ((category), ())", "nodes")
def silent_diagnostics(t):
    """Every fourth part neither imports nor exports: what kinds of files these are."""
    k = F.col("p_partkey") % 3
    path = F.when(k == 0, "w/page.tsx").when(k == 1, "w/hooks/a.js").otherwise("w/z.css")
    said = F.when(F.col("p_partkey") % 4 != 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return analytics.silent_diagnostics(t.part.select(path.alias("canonical_path"), said.alias("raw_imports"), F.array().cast("array<string>").alias("exports")))


_PAGES = f"""WITH RECURSIVE n AS (SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'app/s' || s_suppkey || '/page.tsx' WHEN 1 THEN 'app/s' || (s_suppkey - 1) || '/layout.tsx' WHEN 2 THEN 'lib/auth-guard' || s_suppkey || '.ts'
    WHEN 3 THEN 'lib/u' || s_suppkey || '.ts' ELSE 'app/login/s' || s_suppkey || '/page.tsx' END AS file FROM supplier),
e AS (SELECT a.file AS src, b.file AS dst FROM n a JOIN n b ON b.k = a.k + CASE WHEN a.k % 5 = 1 AND a.k % 2 = 0 THEN 1 WHEN a.k % 5 = 0 THEN 3 WHEN a.k % 5 = 3 AND a.k % 3 = 0 THEN 5 END),
reach(root, node) AS (SELECT file, file FROM n UNION SELECT root, dst FROM reach JOIN e ON src = node),
p AS (SELECT n.file, regexp_extract(n.file, '^app(/.*)/page.tsx$', 1) AS url, l.file AS layout, min(e.dst) AS guard FROM n LEFT JOIN n l ON n.k % 5 = 0 AND l.k = n.k + 1 LEFT JOIN e ON e.src = l.file WHERE n.k % 5 IN (0, 4) GROUP BY ALL),
c AS (SELECT p.file, count(DISTINCT node) FILTER (root = p.file) AS own, count(DISTINCT node) AS whole FROM p JOIN reach ON root = p.file OR root = p.layout GROUP BY 1),
x AS (SELECT p.*, own, whole, CASE WHEN guard IS NULL THEN 'public' ELSE 'protected' END AS auth_state, CASE WHEN guard IS NULL AND url NOT LIKE '/login/%' THEN 1 ELSE 0 END AS late, len(string_split(url, '/')) - 1 AS depth FROM p JOIN c USING (file)),
f AS (SELECT auth_state, arg_min(file, (late, depth, -own, file)) AS landing FROM x GROUP BY 1)
SELECT x.file, url, 'page' AS kind, x.auth_state, CASE WHEN guard IS NULL THEN 0.6 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN guard IS NULL THEN 'no guard found on any ancestor layout' ELSE 'layout.tsx imports ' || guard END AS evidence,
    CASE WHEN layout IS NULL THEN x.file ELSE layout || ',' || x.file END AS render_chain, whole::BIGINT AS reach_count, own::BIGINT AS own_reach_count, floor(whole * 10000.0::DOUBLE / (SELECT count(*) FROM n) + 0.5) / 10000 AS reach_ratio, x.file = landing AS is_landing
FROM x JOIN f USING (auth_state) ORDER BY own DESC, x.file LIMIT {S.MAX_ENTRY_POINTS}"""


@query(_PAGES)
def entry_points(t):
    """Pages with layouts, some guarded, that reach chains of libraries: ranked roots with their reach and landings."""
    k, kind = F.col("s_suppkey"), F.col("s_suppkey") % 5
    of = lambda before, n, after: F.concat(F.lit(before), n.cast("string"), F.lit(after))
    path = F.when(kind == 0, of("app/s", k, "/page.tsx")).when(kind == 1, of("app/s", k - 1, "/layout.tsx")).when(kind == 2, of("lib/auth-guard", k, ".ts")).when(kind == 3, of("lib/u", k, ".ts")).otherwise(of("app/login/s", k, "/page.tsx"))
    n = t.supplier.select(k.alias("k"), path.alias("canonical_path"))
    step = F.when((F.col("k") % 5 == 1) & (F.col("k") % 2 == 0), 1).when(F.col("k") % 5 == 0, 3).when((F.col("k") % 5 == 3) & (F.col("k") % 3 == 0), 5)
    to = n.select((F.col("k") + step).alias("k"), F.col("canonical_path").alias("source")).join(n.withColumnRenamed("canonical_path", "target"), "k")
    e = to.select("source", "target", F.lit("BELONGS_TO_DOMAIN").alias("type"), F.lit(False).alias("is_synthetic"))
    files = n.select("canonical_path", F.array().cast("array<string>").alias("external_dependencies"), F.lit(None).cast("string").alias("cluster_id"), F.lit(None).cast("string").alias("domain"))
    return analytics.entry_points(files, e).drop("cluster_id", "domain").withColumn("render_chain", F.array_join("render_chain", ","))
