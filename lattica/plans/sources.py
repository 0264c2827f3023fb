"""Queries on what sources read: registries, configuration files, manifests, exported history, polls."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import cluster
from lattica.plans import views as v
from lattica.plans.registry import query
from lattica.sources import code, git
from lattica.streaming import progress, state


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query(" SELECT row_number() OVER (ORDER BY canonical_path) - 1 AS node_id, canonical_path FROM paths", "paths")
def file_registry(t):
    """Dense ids in the order of paths."""
    return code.registry(v.paths(t))


@query("SELECT 'apps/' || p_partkey AS scope, a.alias, CASE a.ord WHEN 0 THEN 'apps/' || p_partkey || '/src' || p_size ELSE 'apps/lib' END AS dir, a.ord::INTEGER AS ord FROM part, (VALUES ('@', 0), ('~lib', 1)) a(alias, ord)")
def path_aliases(t):
    """A compiler configuration with comments and trailing commas for each part."""
    k = F.col("p_partkey")
    text = _text('{\n  // aliases, "paths": {}\n  "compilerOptions": { "paths": { "@/*": ["./src', F.col("p_size"), '/*", "./other/*"], "~lib": ["../lib"], }, } /* end */ }')
    return code.path_aliases(t.part.select(_text("apps/", k, "/tsconfig.json").alias("canonical_path"), text.alias("source")))


@query("""SELECT '@s/p' || (p_partkey % 7) AS package, min(CASE p_partkey % 3 WHEN 0 THEN 'pkgs/a' ELSE 'tools/x/b' END || p_partkey) AS dir FROM part WHERE p_partkey % 3 < 2 GROUP BY 1""")
def workspace_packages(t):
    """Packages below the globs of a root manifest and of a workspace file; those elsewhere are no members."""
    k = F.col("p_partkey")
    dir_ = F.when(k % 3 == 0, _text("pkgs/a", k)).when(k % 3 == 1, _text("tools/x/b", k)).otherwise(_text("other/c", k))
    members = t.part.select(F.concat(dir_, F.lit("/package.json")).alias("canonical_path"), _text('{"name": "@s/p', k % 7, '"}').alias("source"))
    top = t.region.where("r_regionkey = 0")
    root = top.select(F.lit("package.json").alias("canonical_path"), F.lit('{"name": "root", "workspaces": {"packages": ["pkgs/*"]}}').alias("source"))
    globs = top.select(F.lit("pnpm-workspace.yaml").alias("canonical_path"), F.lit("packages:\n  # tools\n  - 'tools/**'\n  - '!other/*'\n").alias("source"))
    return code.workspace_packages(members.unionByName(root), globs)


@query("""SELECT o_custkey::VARCHAR AS project, 'c' || o_orderkey AS sha, 'u' || (o_custkey % 9) AS author, 'u' || (o_custkey % 9) || '@x.org' AS email, o_orderkey * 60 AS epoch, 'fix ' || o_orderpriority AS subject,
k.kind, CASE WHEN k.kind IS NOT NULL THEN k.path || o_orderkey || '.ts' END AS path FROM orders JOIN (VALUES (0, 'ADD', 'src/a'), (0, 'RENAME', 'src/new'), (1, 'MODIFY', 'src/b'), (2, NULL, NULL)) k(m, kind, path) ON o_orderkey % 3 = k.m""")
def git_log(t):
    """The history of each customer as one exported text, a commit for each order."""
    k = F.col("o_orderkey")
    changes = F.when(k % 3 == 0, _text("\nA\tsrc/a", k, ".ts\nR090\tsrc/old\tsrc/new", k, ".ts\n")).when(k % 3 == 1, _text("\nM\tsrc/b", k, ".ts\n")).otherwise(F.lit("\n"))
    who = F.col("o_custkey") % 9
    block = F.concat(_text("\x01c", k, "\x02u", who, "\x02u", who, "@x.org\x02", k * 60, "\x02fix ", F.col("o_orderpriority"), "\n"), changes)
    text = t.orders.groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.array_join(F.collect_list(block), "").cast("binary").alias("content"))
    return git.log(text).withColumn("epoch", F.col("committed_at").cast("long")).drop("committed_at")


@query("""SELECT 'f' || l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INTEGER AS line,
CASE WHEN l_linenumber % 4 <> 0 THEN 'u' || (l_linenumber % 4) END AS author, CASE WHEN l_linenumber % 4 <> 0 THEN 'u' || (l_linenumber % 4) || '@x.org' END AS email FROM lineitem""")
def git_blame(t):
    """A file for each order with a line for each of its items; every fourth isn't committed."""
    n = F.col("l_linenumber")
    who = F.when(n % 4 == 0, F.lit("Not Committed Yet")).otherwise(_text("u", n % 4))
    row = F.concat(F.lit("author "), who, F.lit("\nauthor-mail <"), F.when(n % 4 == 0, F.lit("not.committed.yet")).otherwise(_text("u", n % 4, "@x.org")), F.lit(">\n\tlet x = 1;\n"))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("row"))))
    text = t.lineitem.groupBy(_text("f", F.col("l_orderkey")).alias("key")).agg(F.array_join(F.transform(rows, lambda x: x["row"]), "").cast("binary").alias("content"))
    return git.blame(text)


_MANIFESTS = ['{"dependencies": {"lodash": "1", "next": "1"}}', '{"type": "module"}', '{"devDependencies": {"koa": "1"}}', "not json", '{"type": "module", "dependencies": {"express": "1"}}']


@query("SELECT ['WEB_FRAMEWORK_NEXTJS', 'PURE_LIBRARY_ESM', 'WEB_API_NODEJS_CJS', 'UNKNOWN', 'WEB_API_NODEJS_ESM'][1 + p_partkey % 5] AS paradigm, count(*)::BIGINT AS n FROM part GROUP BY 1")
def paradigms(t):
    """What the manifest of each part is taken for."""
    text = F.get(F.array(*(F.lit(m) for m in _MANIFESTS)), (F.col("p_partkey") % 5).cast("int"))
    return code.paradigm(t.part.select(text.alias("source"))).groupBy("paradigm").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT s_nationkey % 2 AS k, 'src/' || s_suppkey || '.js' AS p, s_suppkey % 5 = 0 AS c, s_suppkey % 3 = 0 AS e FROM supplier WHERE s_suppkey % 4 <> 0 ORDER BY p LIMIT 20)
SELECT CASE WHEN bool_or(c) AND bool_or(e) THEN 'mixed' WHEN bool_or(c) THEN 'commonjs' WHEN bool_or(e) THEN 'esm' ELSE 'unknown' END AS module_system FROM f""")
def module_system(t):
    """How the first twenty scripts take in others."""
    k = F.col("s_suppkey")
    path = F.concat(F.lit("src/"), k.cast("string"), F.when(k % 4 == 0, F.lit(".css")).otherwise(F.lit(".js")))
    text = F.concat(F.when(k % 5 == 0, F.lit("const a = require('a');\n")).otherwise(F.lit("")), F.when(k % 3 == 0, F.lit("export const b = 1;\n")).otherwise(F.lit("let c;\n")))
    return code.module_system(t.supplier.select(path.alias("canonical_path"), text.alias("source")))


@query(" SELECT node_id, cluster_id || '.' || (length(node_id) % 2) AS cluster_id FROM nodes", "nodes")
def deepest_cluster(t):
    """The leaf of each node in a tree of two levels."""
    n = v.nodes(t)
    below = n.select("node_id", F.concat("cluster_id", F.lit("."), (F.length("node_id") % 2).cast("string")).alias("cluster_id"), F.lit(True).alias("is_leaf"))
    return cluster.leaves(n.withColumn("is_leaf", F.lit(False)).unionByName(below))


@query("""WITH p AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT c_custkey::VARCHAR AS task, CASE WHEN last IS NULL OR last IN ('purchase', 'signup') THEN 'idle' ELSE last END AS stage FROM customer LEFT JOIN p ON user_id = c_custkey""")
def progress_or_idle(t):
    """Where each customer's task stands; one that has ended, or that nothing is known of, is idle."""
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "signup", "failed").when(kind != "error", "running")
    polls = t.events.select(F.col("user_id").alias("task"), "ts", F.col("event_id").alias("seq"), status.alias("status"), kind.alias("stage"))
    return state.progress(polls, t.customer.select(F.col("c_custkey").alias("task")))


@query("SELECT user_id AS task, count(*)::BIGINT AS polls, count(*) >= 60 AND NOT bool_or(event_type = 'purchase') AS timed_out FROM events GROUP BY 1")
def poll_schedule(t):
    """Tasks that were asked for sixty times without an end."""
    return progress.poll_schedule(t.events.select(F.col("user_id").alias("task"), (F.col("event_type") == "purchase").alias("terminal")), 60)
