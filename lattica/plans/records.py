"""Queries on snapshots, ownership, progress and tenants."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica import schemas as S
from lattica.functions import scalar as fn
from lattica.operators import analytics, history, tenancy
from lattica.plans import views as v
from lattica.plans.registry import query
from lattica.streaming import progress, state


@query("SELECT * EXCLUDE t, floor(lines * 100.0::DOUBLE / t * 10 + 0.5) / 10 AS percentage, row_number() OVER (PARTITION BY path ORDER BY lines DESC, author) = 1 AS is_primary FROM (SELECT *, sum(lines) OVER (PARTITION BY path) AS t FROM (SELECT l_partkey AS path, l_suppkey AS author, count(*)::BIGINT AS lines FROM lineitem GROUP BY 1, 2))")
def ownership_shares(t):
    return history.ownership(t.lineitem.select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("author")))


@query("SELECT l_partkey AS path, arg_max(l_suppkey, (n, -l_suppkey)) AS author FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def primary_owner(t):
    return ownership_shares(t).where("is_primary").select("path", "author")


_DELTA = """, d AS (SELECT coalesce(p.path, n.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN p.cluster_id IS DISTINCT FROM n.cluster_id THEN 'moved' END AS change, p.cluster_id AS from_cluster, n.cluster_id AS to_cluster FROM prev p FULL JOIN next n ON p.path = n.path) """


def _delta(t):
    return history.snapshot_delta(v.snapshot(t, 1996), v.snapshot(t, 1997))


@query(_DELTA + "SELECT * FROM d WHERE change IS NOT NULL", "prev next")
def snapshot_delta(t):
    return _delta(t)


@query(_DELTA + "SELECT path, from_cluster, to_cluster FROM d WHERE change = 'moved'", "prev next")
def moved_nodes(t):
    return _delta(t).where("change = 'moved'").select("path", "from_cluster", "to_cluster")


@query(_DELTA + "SELECT coalesce((SELECT string_agg(path, ',' ORDER BY path) FROM d WHERE change = 'added'), '') AS added_nodes, coalesce((SELECT string_agg(path, ',' ORDER BY path) FROM d WHERE change = 'removed'), '') AS removed_nodes, (SELECT count(*) FROM d WHERE change = 'moved')::BIGINT AS moved", "prev next")
def delta_document(t):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return history.delta_document(_delta(t), v.snapshot(t, 1996), v.snapshot(t, 1997)).select(text("added_nodes"), text("removed_nodes"), F.size("moved_nodes").cast("long").alias("moved"))


@query(", k AS (SELECT DISTINCT o_orderpriority AS cluster_id FROM orders) SELECT k.cluster_id, count(n.path)::BIGINT AS files FROM k LEFT JOIN next n ON k.cluster_id = n.cluster_id GROUP BY 1", "next")
def snapshot_counts(t):
    k = t.orders.select(F.col("o_orderpriority").alias("cluster_id")).distinct()
    return analytics.snapshot_sizes(k, v.snapshot(t, 1997))


@query("SELECT o_custkey AS project, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS snapshot FROM orders GROUP BY 1")
def latest_snapshot(t):
    o = t.orders.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("snapshot"), "o_orderdate")
    return history.latest(o, "project", ["o_orderdate", "snapshot"]).select("project", "snapshot")


@query("SELECT o_custkey AS project, o_orderkey AS snapshot, age FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INTEGER AS age FROM orders) WHERE age > 5")
def retention_candidates(t):
    return history.beyond_newest(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], 5).select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("snapshot"), "age")


@query("SELECT o_custkey AS project, o_orderpriority AS snapshot, (count(*) + 1)::BIGINT AS next_number FROM orders GROUP BY 1, 2")
def next_revision(t):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")).cast("long")
    rows = t.orders.select(F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("snapshot"), n.alias("n"))
    return history.next_numbers(rows, ["project", "snapshot"], "n").withColumn("next_number", F.col("next_number").cast("long"))


@query("SELECT o_orderkey AS snapshot, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders")
def prev_snapshot_pairs(t):
    return history.consecutive(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey").select(F.col("o_orderkey").alias("snapshot"), "previous")


@query("SELECT node_id AS path, CASE WHEN node_id LIKE '%7' THEN 'moved' ELSE cluster_id END AS cluster_id FROM nodes", "nodes")
def override_overlay(t):
    n = v.nodes(t).withColumnRenamed("node_id", "path")
    return history.overlay(n, n.where("path like '%7'").select("path", F.lit("moved").alias("cluster_id")))


@query("""WITH b AS (SELECT c_custkey AS k, c_mktsegment AS value, (c_custkey % 3)::BIGINT AS version FROM customer WHERE c_acctbal > 0), c AS (SELECT c_custkey AS k, 'new' AS value, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 2)::BIGINT END AS expected FROM customer WHERE c_mktsegment > 'B'),
j AS (SELECT coalesce(b.k, c.k) AS k, b.value AS old, version, c.value AS new, expected, b.k IS NOT NULL AS stored, c.k IS NOT NULL AS asked FROM b FULL JOIN c ON b.k = c.k),
s AS (SELECT *, CASE WHEN NOT asked THEN 'UNCHANGED' WHEN NOT stored AND expected IS NULL THEN 'INSERTED' WHEN NOT stored OR (expected IS NOT NULL AND expected <> version) THEN 'CONFLICT' ELSE 'UPDATED' END AS status FROM j)
SELECT k, CASE WHEN status IN ('INSERTED', 'UPDATED') THEN new ELSE old END AS value, CASE status WHEN 'INSERTED' THEN 0 WHEN 'UPDATED' THEN version + 1 ELSE version END AS version, status FROM s""")
def optimistic_upsert(t):
    k = F.col("c_custkey")
    b = t.customer.where("c_acctbal > 0").select(k.alias("k"), F.col("c_mktsegment").alias("value"), (k % 3).alias("version"))
    c = t.customer.where("c_mktsegment > 'B'").select(k.alias("k"), F.lit("new").alias("value"), F.when(k % 5 != 0, k % 2).alias("expected"))
    return history.upsert(b, c, "k")


@query("SELECT o_orderpriority AS sha, string_agg(o_orderkey, ',' ORDER BY o_orderkey) FILTER (o_orderstatus = 'F') AS added, string_agg(o_orderkey, ',' ORDER BY o_orderkey) FILTER (o_orderstatus = 'O') AS modified, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS deleted, count(*)::BIGINT AS total FROM orders GROUP BY 1")
def commit_file_lists(t):
    kind = F.when(F.col("o_orderstatus") == "F", "ADD").when(F.col("o_orderstatus") == "O", "MODIFY").otherwise("DELETE")
    d = history.commit_files(t.orders.select(F.col("o_orderpriority").alias("sha"), kind.alias("kind"), F.col("o_orderkey").alias("path")))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return d.select("sha", text("added"), text("modified"), F.size("deleted").cast("long").alias("deleted"), "total")


@query("SELECT o_custkey AS project_id, o_orderkey AS sha FROM orders WHERE o_orderstatus <> 'F'")
def not_analyzed(t):
    o = t.orders.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("sha"), "o_orderstatus")
    return history.not_analyzed(o, o.where("o_orderstatus = 'F'")).select("project_id", "sha")


@query("SELECT l_orderkey AS edge_id, 'duplicate id' AS problem FROM lineitem GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT l_orderkey, 'unknown node' FROM lineitem WHERE l_suppkey % 9 = 0 UNION ALL SELECT l_orderkey, 'self loop' FROM lineitem WHERE l_partkey = l_suppkey")
def edit_violations(t):
    a = t.lineitem.select(F.col("l_orderkey").alias("edge_id"), F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"))
    known = a.select(F.explode(F.array("source_id", F.when(F.col("target_id") % 9 != 0, F.col("target_id")))).alias("node_id"))
    ends = a.select(F.col("target_id").alias("node_id")).where("node_id % 9 = 0")
    # parts whose number is an unknown supplier's go by another name
    known = known.join(ends.distinct(), "node_id", "left_anti").distinct()
    named = a.withColumn("source_id", F.when((F.col("source_id") % 9 == 0) & (F.col("source_id") != F.col("target_id")), F.lit(None)).otherwise(F.col("source_id")))
    return history.edit_violations(named.where("source_id is not null or true").withColumn("source_id", F.coalesce("source_id", F.lit(-1))), known.unionByName(t.spark.range(1).select(F.lit(-1).cast("long").alias("node_id"))))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def bulk_delete(t):
    doomed = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return history.without(t.orders, doomed, ["o_custkey"]).select("o_orderkey")


@query("SELECT l_orderkey AS edge_id, l_linenumber AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT -o_orderkey, 0 FROM orders WHERE o_orderstatus = 'P'")
def edited_edges(t):
    p = t.orders.where("o_orderstatus = 'P'")
    return history.edited_edges(t.lineitem.select(F.col("l_orderkey").alias("edge_id"), F.col("l_linenumber").alias("n")), p.select(F.col("o_orderkey").alias("edge_id")), p.select((-F.col("o_orderkey")).alias("edge_id"), F.lit(0).alias("n")))


@query("SELECT user_id AS task, arg_max(event_type, (ts, event_id)) AS stage, max((ts, event_id))[1] AS ts FROM events GROUP BY 1".replace("max((ts, event_id))[1]", "max(ts)"))
def progress_latest(t):
    return progress.latest(t.events.select(F.col("user_id").alias("task"), F.col("event_type").alias("stage"), "ts", F.col("event_id").alias("seq")))


@query("""WITH g AS (SELECT user_id, event_id, event_type = 'error' AS bad, sum((event_type <> 'error')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
SELECT user_id AS task, coalesce(max(n), 0)::BIGINT AS longest_run, coalesce(max(n), 0) >= 5 AS gave_up FROM (SELECT user_id, g, count(*) FILTER (bad) AS n FROM g GROUP BY 1, 2) GROUP BY 1""")
def error_runs(t):
    return progress.error_runs(t.events.select(F.col("user_id").alias("task"), (F.col("event_type") == "error").alias("bad"), "ts", F.col("event_id").alias("seq")))


@query("""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS task, event_id AS seq, event_type AS stage, CASE event_type WHEN 'error' THEN NULL WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'failed' ELSE 'running' END AS status,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT task, 0::BIGINT AS n, 0::BIGINT AS seq, 0::BIGINT AS polls, 0::BIGINT AS errors, NULL::VARCHAR AS stage, NULL::VARCHAR AS outcome FROM e WHERE n = 1
    UNION ALL SELECT task, n, seq, polls, errors, stage, CASE WHEN status IN ('completed', 'failed') THEN status WHEN errors >= 5 THEN 'lost' WHEN polls >= 900 THEN 'timed out' END AS outcome
    FROM (SELECT e.task, e.n, e.seq, e.status, CASE WHEN r.outcome IS NULL THEN r.polls ELSE 0 END + 1 AS polls, CASE WHEN e.status IS NOT NULL THEN 0 WHEN r.outcome IS NULL THEN r.errors + 1 ELSE 1 END AS errors,
          CASE WHEN e.status IS NOT NULL THEN e.stage WHEN r.outcome IS NULL THEN r.stage END AS stage FROM r JOIN e ON e.task = r.task AND e.n = r.n + 1))
SELECT task, seq, outcome, polls, stage FROM r WHERE outcome IS NOT NULL""")
def poll_outcomes(t):
    """How each run of polls of a task ended; an error is a failed poll."""
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "signup", "failed").when(kind != "error", "running")
    return state.poll_outcomes(t.events.select(F.col("user_id").alias("task"), "ts", F.col("event_id").alias("seq"), status.alias("status"), kind.alias("stage")), 10**9)


@query("SELECT l_orderkey AS task, l_linenumber AS n, least(100, CAST(l_quantity AS BIGINT) * 100 // 40)::BIGINT AS percent FROM lineitem")
def clone_percent(t):
    return t.lineitem.select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("n"), fn.percent(F.col("l_quantity").cast("long"), F.lit(40)).alias("percent"))


@query("SELECT conv_id AS upload_id, string_agg(text, '' ORDER BY turn, text) AS content, count(*)::BIGINT AS chunks FROM conversations GROUP BY 1 HAVING count(*) = max(turn) + 1 AND count(DISTINCT turn) = count(*)")
def chunk_assembly(t):
    c = t.conversations.select(F.col("conv_id").alias("upload_id"), F.col("turn").alias("index"), F.col("text").alias("data"), (F.max("turn").over(_w("conv_id")) + 1).alias("total"))
    return progress.assembled(c)


def _w(key):
    from pyspark.sql import Window

    return Window.partitionBy(key)


@query("""WITH m AS (SELECT o_orderkey AS project_id, c_custkey AS user_id, o_custkey AS owner, c_custkey % 3 AS r FROM orders JOIN customer oc ON o_custkey = oc.c_custkey JOIN customer uc ON false WHERE false),
o AS (SELECT o_orderkey AS project_id, c_nationkey AS org_id, o_custkey AS owner_id FROM orders JOIN customer ON o_custkey = c_custkey), u AS (SELECT c_nationkey AS org_id, c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'ADMIN' ELSE 'MEMBER' END AS role FROM customer)
SELECT user_id, count(*)::BIGINT AS projects FROM o JOIN u USING (org_id) WHERE role <> 'MEMBER' OR owner_id = user_id OR user_id = owner_id + 25 GROUP BY 1""".replace("WITH m AS (SELECT o_orderkey AS project_id, c_custkey AS user_id, o_custkey AS owner, c_custkey % 3 AS r FROM orders JOIN customer oc ON o_custkey = oc.c_custkey JOIN customer uc ON false WHERE false),\no AS", "WITH o AS"))
def visible_projects(t):
    org = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("org_id"))
    p = t.orders.join(org, "o_custkey").select(F.col("o_orderkey").alias("project_id"), "org_id", F.col("o_custkey").alias("owner_id"))
    u = t.customer.select(F.col("c_nationkey").alias("org_id"), F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 3 == 0, "ADMIN").otherwise("MEMBER").alias("role"))
    m = p.select("project_id", (F.col("owner_id") + 25).alias("user_id"))
    return analytics.visible_counts(p, m, u)


@query("SELECT c_custkey AS user_id, ['OWNER', 'ADMIN', 'MEMBER', 'VIEWER', 'NONE'][1 + c_custkey % 5] AS role, c_custkey % 5 <= 1 AS is_admin FROM customer")
def role_threshold(t):
    role = F.get(F.array(*(F.lit(r) for r in (*S.ROLES, "NONE"))), (F.col("c_custkey") % 5).cast("int"))
    return t.customer.select(F.col("c_custkey").alias("user_id"), role.alias("role"), analytics.at_least(role, "ADMIN").alias("is_admin"))


@query("SELECT o_orderkey AS member, c_name AS name, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def member_left_join(t):
    c = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return tenancy.members_with_profiles(t.orders.withColumnRenamed("o_custkey", "user_id"), c).select(F.col("o_orderkey").alias("member"), "name", "segment")


@query("""WITH RECURSIVE s AS (SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(trim(p_brand || CASE WHEN p_partkey % 4 = 0 THEN ' ' || p_size % 5 ELSE '!' END)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS base FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(base, '^(brand-[0-9]+).*$', '\\1') ORDER BY id) AS turn, regexp_replace(base, '^(brand-[0-9]+).*$', '\\1') AS family FROM s),
g(family, turn, taken, slug, id) AS (SELECT family, turn, [base], base, id FROM f WHERE turn = 1 UNION ALL SELECT f.family, f.turn, list_append(g.taken, x.slug), x.slug, f.id FROM g JOIN f ON f.family = g.family AND f.turn = g.turn + 1, LATERAL (SELECT list_filter(list_prepend(f.base, list_transform(range(1, len(g.taken) + 2), lambda n: f.base || '-' || n)), lambda c: NOT list_contains(g.taken, c))[1] AS slug) x) SELECT id, slug FROM g""")
def slug_unique(t):
    """Titles of brands, a quarter with a number behind that others get, too."""
    k = F.col("p_partkey")
    title = F.concat("p_brand", F.when(k % 4 == 0, F.concat(F.lit(" "), F.col("p_size") % 5)).otherwise("!"))
    return analytics.unique_slugs(t.part.select(k.alias("id"), title.alias("title")))


@query("SELECT o_orderkey AS id, o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_custkey % 2 = 0 AS valid FROM orders")
def invitation_valid(t):
    mail = F.when(F.col("o_custkey") % 2 == 0, "A@b.c").otherwise("x@b.c")
    status = F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("ACCEPTED")
    return t.orders.select(F.col("o_orderkey").alias("id"), analytics.invitation_valid(status, F.col("o_orderdate"), mail, F.lit("a@B.C"), F.lit("1996-01-01").cast("timestamp")).alias("valid"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'https://github.com/acme/' || c_mktsegment || '.git' WHEN c_custkey % 3 = 1 THEN 'HTTP://www.github.com/acme/x.git' END AS url FROM customer")
def repository_urls(t):
    u = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" https://github.com/acme/"), "c_mktsegment", F.lit("/"))).when(F.col("c_custkey") % 3 == 1, "HTTP://www.github.com/acme/x.git").otherwise("https://example.org/a/b")
    return t.customer.select(F.col("c_custkey").alias("id"), fn.repository_url(u).alias("url"))


@query("SELECT page_id, left(md5(url), 7) AS short_sha, left(html, 256) AS message, nullif(trim(CASE WHEN page_id % 2 = 0 THEN '  ' ELSE ' a ' END), '') AS author FROM pages")
def snapshot_summary(t):
    author = F.when(F.col("page_id") % 2 == 0, "  ").otherwise(" a ")
    return t.pages.select("page_id", F.substring(F.md5("url"), 1, 7).alias("short_sha"), F.substring("html", 1, 256).alias("message"), fn.trim_to_null(author).alias("author"))


@query("SELECT l_suppkey AS author, l_linenumber AS email, count(*)::BIGINT AS lines, count(DISTINCT l_partkey)::BIGINT AS files, floor(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lineitem) * 10 + 0.5) / 10 AS percentage FROM lineitem GROUP BY 1, 2")
def ownership_totals(t):
    return history.ownership_totals(t.lineitem.select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("author"), F.col("l_linenumber").alias("email")), ("author", "email"))


@query("SELECT c_nationkey AS org_id, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7")
def user_organisations(t):
    members = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("org_id"))
    return tenancy.organisations_of(7, members, t.nation.select(F.col("n_nationkey").alias("org_id"), F.col("n_name").alias("name"))).select("org_id", "name")


@query("SELECT 3 * c_custkey AS org_id FROM customer WHERE 3 * c_custkey NOT IN (SELECT o_custkey FROM orders)")
def deletable_organisations(t):
    return tenancy.deletable(t.customer.select((3 * F.col("c_custkey")).alias("org_id")), t.orders.select(F.col("o_custkey").alias("org_id")))


_MEMBERS = "m AS (SELECT l_orderkey AS project_id, l_linenumber::BIGINT AS user_id, CASE l_linenumber WHEN 1 THEN 'OWNER' WHEN 2 THEN 'ADMIN' ELSE 'MEMBER' END AS role FROM lineitem)"


def _members(t):
    n = F.col("l_linenumber")
    return t.lineitem.select(F.col("l_orderkey").alias("project_id"), n.cast("long").alias("user_id"), F.when(n == 1, "OWNER").when(n == 2, "ADMIN").otherwise("MEMBER").alias("role"))


@query(f"WITH {_MEMBERS}, a AS (SELECT o_orderkey AS project_id, (o_custkey % 5)::BIGINT AS user_id, CASE o_orderstatus WHEN 'F' THEN 'ADMIN' WHEN 'P' THEN 'OWNER' END AS new_role FROM orders) SELECT a.project_id, a.user_id, CASE WHEN role IS NULL THEN 'NOT_FOUND' WHEN role = 'OWNER' OR new_role = 'OWNER' THEN 'FORBIDDEN' WHEN new_role IS NULL THEN 'REMOVED' ELSE 'UPDATED' END AS status FROM a LEFT JOIN m ON a.project_id = m.project_id AND a.user_id = m.user_id")
def member_changes(t):
    s = F.col("o_orderstatus")
    asked = t.orders.select(F.col("o_orderkey").alias("project_id"), (F.col("o_custkey") % 5).cast("long").alias("user_id"), F.when(s == "F", "ADMIN").when(s == "P", "OWNER").alias("new_role"))
    return tenancy.member_changes(_members(t), asked).select("project_id", "user_id", "status")


@query("SELECT o_orderkey AS invitation_id, CASE WHEN o_orderstatus <> 'O' THEN 'CLOSED' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'EXPIRED' WHEN o_custkey % 2 = 0 THEN 'ACCEPTED' ELSE 'FORBIDDEN' END AS result, CASE WHEN o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_custkey % 2 = 0 THEN 'MEMBER' END AS role FROM orders UNION ALL SELECT -1 - c_custkey, 'NOT_FOUND', NULL FROM customer")
def invitation_accept(t):
    k = F.col("o_orderkey").alias("invitation_id")
    stored = t.orders.select(k, F.col("o_custkey").alias("org_id"), F.lit("A@b.c").alias("email"), F.lit("MEMBER").alias("role"), F.when(F.col("o_orderstatus") == "O", "PENDING").otherwise("ACCEPTED").alias("status"), F.col("o_orderdate").cast("timestamp").alias("expires_at"))
    asked = t.orders.select(k, F.col("o_custkey").alias("user_id"), F.when(F.col("o_custkey") % 2 == 0, "a@B.c").otherwise("x@b.c").alias("email"))
    asked = asked.unionByName(t.customer.select((-F.col("c_custkey") - 1).alias("invitation_id"), F.col("c_custkey").alias("user_id"), F.lit("a@b.c").alias("email")))
    return tenancy.accepted(stored, asked, F.lit("1996-01-01").cast("timestamp")).select("invitation_id", "result", "role")


@query("SELECT user_id AS project_id, arg_min(event_id, (ts, event_id)) AS task FROM events GROUP BY 1")
def first_task(t):
    return progress.first_task(t.events.select(F.col("event_id").alias("task"), F.col("user_id").alias("project_id"), F.struct("ts", "event_id").alias("seq")))


@query("SELECT o_custkey AS project, o_orderkey AS note, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INTEGER AS place FROM orders")
def notes_in_order(t):
    n = t.orders.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("note"), "o_orderdate")
    return history.in_order(n, "project", ["o_orderdate", "note"], newest_first=True).select("project", "note", "place")


@query("WITH r AS (SELECT DISTINCT o_custkey AS p, o_orderpriority AS s FROM orders) SELECT p AS project_id, s AS snapshot_id, 2::BIGINT AS number, CASE WHEN p % 3 = 0 THEN 'x' || p ELSE '' END AS removed FROM r WHERE p % 3 <> 1")
def revision_create(t):
    """New revisions beside one that each snapshot has: copies of it, copies of one that isn't there, and empty ones."""
    k = F.col("o_custkey")
    r = t.orders.select(k.alias("project_id"), F.col("o_orderpriority").alias("snapshot_id")).distinct()
    stored = r.select("*", F.lit(1).cast("long").alias("number"), F.array(F.concat(F.lit("x"), "project_id")).alias("removed"), F.array().cast("array<string>").alias("added"))
    asked = r.withColumn("copy_from", F.when(F.col("project_id") % 3 == 0, F.lit(1)).when(F.col("project_id") % 3 == 1, F.lit(9)).cast("long"))
    return history.revision_created(stored, asked).select("project_id", "snapshot_id", "number", F.array_join("removed", ",").alias("removed"))
