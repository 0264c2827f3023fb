"""Reports on clusters, entry points and tenants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica import schemas as S
from lattica.functions import scalar as fn
from lattica.operators.edges import is_journey
from lattica.operators.reach import reach_counts, reach_sets, reached_from_any, union_counts
from lattica.session import written


def cluster_edge_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster_id, size, internal, outgoing, incoming: distinct edges by where their ends are."""
    where = nodes.select("node_id", "cluster_id")
    e = edges.select("source_id", "target_id").distinct().join(where.toDF("source_id", "sc"), "source_id", "left").join(where.toDF("target_id", "tc"), "target_id", "left")
    flows = e.groupBy("sc", "tc").agg(F.count("*").alias("n"))
    same = F.expr("sc <=> tc")
    sides = flows.withColumn("x", F.explode(F.array(F.struct(F.col("sc").alias("c"), F.when(same, F.col("n")).otherwise(0).alias("i"), F.when(same, 0).otherwise(F.col("n")).alias("o"), F.lit(0).cast("long").alias("e")), F.struct(F.col("tc").alias("c"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("o"), F.when(same, 0).otherwise(F.col("n")).alias("e")))))
    counts = sides.groupBy(F.col("x.c").alias("cluster_id")).agg(F.sum("x.i").alias("internal"), F.sum("x.o").alias("outgoing"), F.sum("x.e").alias("incoming"))
    sizes = where.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("size"))
    return sizes.join(counts, "cluster_id", "left").na.fill(0, ["internal", "outgoing", "incoming"]).select("cluster_id", "size", "internal", "outgoing", "incoming")


def cohesion(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster_id, size, topological, semantic, basis: files with and without edges to fellow members."""
    where = nodes.select("node_id", "cluster_id")
    inner = edges.select("source_id", "target_id").distinct().join(where.toDF("source_id", "sc"), "source_id").join(where.toDF("target_id", "tc"), "target_id").where("sc = tc")
    linked = inner.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct().withColumn("linked", F.lit(1))
    per = where.where("cluster_id is not null").join(linked, "node_id", "left").groupBy("cluster_id").agg(F.count("*").alias("size"), F.count("linked").alias("topological"))
    per = per.withColumn("semantic", F.col("size") - F.col("topological"))
    return per.withColumn("basis", F.when(F.col("size") == 1, "singleton").when(F.col("topological") >= F.col("semantic"), "topological").otherwise("semantic_blob"))


def size_stats(nodes: DataFrame) -> DataFrame:
    sizes = nodes.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("size"))
    return sizes.agg(F.min("size").alias("min_size"), F.max("size").alias("max_size"), fn.half_up(F.avg("size"), 1).alias("avg_size"), F.count_if(F.col("size") == 1).alias("singletons"), F.count_if(F.col("size") > 15).alias("large_clusters"), F.min_by("cluster_id", F.struct(-F.col("size"), F.col("cluster_id"))).alias("largest"))


def directory_histogram(files: DataFrame) -> DataFrame:
    """cluster_id, dir, files, is_primary; files: cluster_id, canonical_path."""
    per = files.groupBy("cluster_id", fn.parent(F.col("canonical_path")).alias("dir")).agg(F.count("*").alias("files"))
    return per.withColumn("is_primary", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("files"), "dir")) == 1)


def root_cause(report: DataFrame, edges: int) -> DataFrame:
    """The finding of a report (cluster_id, size, basis): why clusters are large, lonely or loose."""
    one = report.agg(F.max("size").alias("size"), F.min_by("cluster_id", F.struct(-F.col("size"), F.col("cluster_id"))).alias("cluster_id"), F.count_if(F.col("size") == 1).alias("singletons"), F.count_if(F.col("basis") == "semantic_blob").alias("semantic_blobs"))
    found = one.where("size > 15 or singletons > 8 or semantic_blobs > 2")
    cause = F.when(F.lit(edges == 0), "no edges").when(F.col("singletons") > 8, "singletons").when(F.col("semantic_blobs") > 2, "semantic blobs").otherwise("large cluster")
    return found.withColumn("cause", cause)


def top_neighbours(edges: DataFrame, k: int = 3, incoming: bool = False) -> DataFrame:
    """source_id and its k heaviest targets, joined by comma; incoming: target_id and its heaviest sources."""
    own, other, name = ("target_id", "source_id", "sources") if incoming else ("source_id", "target_id", "targets")
    w = Window.partitionBy(own).orderBy(F.desc("weight"), other)
    top = edges.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.groupBy(own).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", other))), lambda s: s[other]), ",").alias(name))


def cluster_report(nodes: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """A row for each cluster: its numbers, basis, directories and members with their placement and heaviest neighbours.

    nodes: node_id, canonical_path, cluster_id; edges: source_id, target_id, weight."""
    held = nodes.where("cluster_id is not null").select("node_id", "canonical_path", "cluster_id")
    summed = edges.groupBy("source_id", "target_id").agg(F.sum("weight").alias("weight"))
    where = held.select("node_id", "cluster_id")
    inner = summed.join(where.toDF("source_id", "sc"), "source_id").join(where.toDF("target_id", "tc"), "target_id").where("sc = tc")
    linked = inner.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("links"))
    out = top_neighbours(summed, k).withColumnRenamed("source_id", "node_id")
    back = top_neighbours(summed, k, True).withColumnRenamed("target_id", "node_id")
    files = held.join(linked, "node_id", "left").join(out, "node_id", "left").join(back, "node_id", "left")
    basis = F.when(F.col("links") > 0, "topological").otherwise("semantic")
    member = F.struct("canonical_path", basis.alias("basis"), F.coalesce("links", F.lit(0)).alias("links"), fn.file_category(F.col("canonical_path")).alias("category"), "targets", "sources")
    members = files.groupBy("cluster_id").agg(F.array_sort(F.collect_list(member)).alias("members"))
    dirs = directory_histogram(held).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("rank"), "dir", "files"))).alias("d"))
    dirs = dirs.select("cluster_id", F.transform("d", lambda x: F.struct(x["dir"].alias("dir"), x["files"].alias("files"))).alias("directories"))
    return cluster_edge_counts(nodes, edges).join(cohesion(nodes, edges).drop("size"), "cluster_id").join(members, "cluster_id").join(dirs, "cluster_id")


def category_histogram(files: DataFrame) -> DataFrame:
    """category, files: what kinds of files there are; files: canonical_path."""
    return files.groupBy(fn.file_category(F.col("canonical_path")).alias("category")).agg(F.count("*").alias("files"))


def breakdown(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value, files, share (percent): rows counted by each dimension and altogether, in one pass.

    A null value of a dimension is a value of its own; the row of all has dimension `all`."""
    sets = [[d] for d in dimensions] + [[]]
    counted = rows.groupingSets(sets, *dimensions).agg(F.count("*").alias("files"), *(F.grouping(d).alias(f"__{d}") for d in dimensions))
    dimension, value = F.lit("all"), F.lit(None).cast("string")
    for d in reversed(dimensions):
        dimension = F.when(F.col(f"__{d}") == 0, d).otherwise(dimension)
        value = F.when(F.col(f"__{d}") == 0, F.col(d).cast("string")).otherwise(value)
    named = counted.select(dimension.alias("dimension"), value.alias("value"), "files")
    total = named.where("dimension = 'all'").agg(F.max("files").alias("total"))
    return named.crossJoin(F.broadcast(total)).select("dimension", "value", "files", fn.half_up(F.col("files") * 100.0 / F.col("total"), 1).alias("share"))


def singleton_diagnostics(files: DataFrame, edges: DataFrame) -> DataFrame:
    """What kinds of files are the only ones of their cluster, by category, degree and role (`breakdown`).

    files: node_id, canonical_path, cluster_id; edges: source_id, target_id."""
    sizes = files.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("node_id").alias("node_id"))
    alone = files.join(sizes.where("size = 1").select("node_id"), "node_id", "left_semi")
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    degrees = alone.select("node_id", "canonical_path").join(ends.groupBy("node_id").agg(F.max("o").alias("o"), F.max("i").alias("i")), "node_id", "left").na.fill(0, ["o", "i"])
    enters, leaves = F.col("i") > 0, F.col("o") > 0
    degree = F.when(enters & leaves, "both").when(leaves, "entry-only").when(enters, "sink-only").otherwise("isolated")
    role = F.when(leaves & ~enters, "ENTRY_POINT").when(enters & ~leaves, "TERMINAL_SINK").otherwise("INTERNAL")
    return breakdown(degrees.select(fn.file_category(F.col("canonical_path")).alias("category"), degree.alias("degree"), role.alias("role")), ["category", "degree", "role"])


def silent_diagnostics(files: DataFrame) -> DataFrame:
    """What kinds of files neither import nor export anything, by category (`breakdown`).

    files: canonical_path, raw_imports, exports (arrays; a null one counts as empty)."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return breakdown(files.where(none("raw_imports") & none("exports")).select(fn.file_category(F.col("canonical_path")).alias("category")), ["category"])


def snapshot_sizes(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """cluster_id, files of every cluster, empty ones included; clusters: cluster_id; members: path, cluster_id."""
    counted = members.groupBy("cluster_id").agg(F.count("path").alias("files"))
    return clusters.select("cluster_id").distinct().join(counted, "cluster_id", "left").na.fill(0, ["files"])


def unreached(nodes: DataFrame, reached: DataFrame, most: int = S.UNREACHED_SAMPLE) -> DataFrame:
    """unreached_count and a sorted sample of the nodes that aren't reached; both: one column of the same name."""
    key = nodes.columns[0]
    rest = nodes.join(reached, key, "left_anti")
    sample = rest.orderBy(key).limit(most).agg(F.array_sort(F.collect_list(key)).alias("unreached_sample"))
    return rest.agg(F.count("*").alias("unreached_count")).crossJoin(sample)


def top_members(nodes: DataFrame, k: int = 5) -> DataFrame:
    """The k most central members of each cluster."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc("centrality_score"), "canonical_path")
    return nodes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("cluster_id", "canonical_path", "rank")


def auto_titles(nodes: DataFrame) -> DataFrame:
    """cluster_id, title: the commonest directory name of the top members."""
    top = top_members(nodes).withColumn("dir", fn.name(fn.parent(F.col("canonical_path"))))
    per = top.groupBy("cluster_id", "dir").agg(F.count("*").alias("n")).groupBy("cluster_id").agg(F.min_by("dir", F.struct(-F.col("n"), F.col("dir"))).alias("dir"))
    return per.select("cluster_id", F.concat(F.initcap(F.translate("dir", "-_.", "   ")), F.lit(" Module")).alias("title"))


def chunks(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """rows with chunk: even chunks of a size inside each group."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size))


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ranked journey roots with auth state, evidence, render chain and reach.

    nodes: canonical_path, external_dependencies, cluster_id, domain; edges: source, target, type,
    is_synthetic (all by path)."""
    used = edges.where(is_journey(F.col("type"), F.col("is_synthetic"))).select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()
    path = F.col("canonical_path")
    stem, url = F.lower(fn.stem(path)), fn.page_url(path)
    deps = F.coalesce("external_dependencies", F.array().cast("array<string>"))
    serves = F.arrays_overlap(deps, F.array(F.lit("express"), F.lit("fastify"), F.lit("koa")))
    kind = F.when(url.isNotNull(), F.when(stem == "route", "api").otherwise("page")).when(stem.isin(*S.SERVER_STEMS) & serves, "server")
    roots = nodes.select(path.alias("file"), url.alias("url"), kind.alias("kind"), "cluster_id", "domain").where("kind is not null")
    dir_of = lambda c: F.when(c.contains("/"), F.regexp_replace(c, "/[^/]*$", "")).otherwise("")
    layouts = nodes.where(F.lower(fn.stem(path)).isin(*S.JOURNEY_LAYOUTS)).groupBy(dir_of(path).alias("dir")).agg(F.min("canonical_path").alias("layout"))
    parts = F.split(dir_of(F.col("file")), "/")
    up = F.when(dir_of(F.col("file")) == "", F.array(F.lit(""))).otherwise(F.concat(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/")), F.array(F.lit(""))))
    chain = roots.where("kind = 'page'").select("file", F.posexplode(up).alias("depth", "dir")).join(layouts, "dir").select("file", "depth", "layout")
    guards = chain.join(used, chain["layout"] == used["src"]).where(F.col("dst").rlike(S.GUARD)).groupBy("file").agg(F.min_by(F.struct("layout", "dst"), F.struct("depth", "dst")).alias("g"))
    chains = chain.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "layout")), asc=False), lambda s: s["layout"]).alias("above"))
    e = roots.join(guards, "file", "left").join(chains, "file", "left")
    e = e.withColumn("render_chain", F.concat(F.coalesce("above", F.array().cast("array<string>")), F.array("file")))
    e = e.withColumn("auth_state", F.when(F.col("g").isNotNull(), "protected").otherwise("public"))
    confidence = F.when(F.col("kind") == "server", 0.95).when((F.col("kind") == "page") & F.col("g").isNull(), 0.6).otherwise(0.9)
    evidence = F.when(F.col("kind") == "page", F.coalesce(F.concat(fn.name(F.col("g.layout")), F.lit(" imports "), F.col("g.dst")), F.lit("no guard found on any ancestor layout")))
    roots_of = e.select(F.col("file").alias("group"), F.explode("render_chain").alias("root"))
    reach = reach_sets(used, roots_of.select(F.col("root").alias("node")).distinct())
    own = reach_counts(reach, e.select(F.col("file").alias("root"))).withColumnsRenamed({"root": "file", "reached": "own_reach_count"})
    whole = union_counts(reach, roots_of).withColumnsRenamed({"group": "file", "reached": "reach_count"})
    total = nodes.agg(F.count("*").alias("total"))
    out = e.join(own, "file").join(whole, "file").crossJoin(F.broadcast(total))
    depth = F.size(fn.segments(F.coalesce("url", F.lit("/"))))
    login = F.when(F.coalesce("url", F.lit("")).rlike(S.LOGIN), 0).otherwise(1)
    order = F.when(F.col("auth_state") == "public", login).otherwise(0)
    landing = out.where("kind in ('page', 'server')").groupBy("auth_state").agg(F.min_by("file", F.struct(order, depth, -F.col("own_reach_count"), F.col("file"))).alias("landing"))
    out = out.join(landing, "auth_state", "left").withColumn("is_landing", F.expr("file <=> landing"))
    return out.select("file", "url", "kind", "auth_state", confidence.alias("confidence"), evidence.alias("evidence"), "render_chain", "cluster_id", "domain", "reach_count", "own_reach_count", fn.half_up(F.col("reach_count") / F.col("total"), 4).alias("reach_ratio"), "is_landing").orderBy(F.desc("own_reach_count"), "file").limit(S.MAX_ENTRY_POINTS)


def coverage(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """reached, total, unreached_count and a sorted sample of files that no entry point reaches."""
    used = edges.where(is_journey(F.col("type"), F.col("is_synthetic"))).select(F.col("source").alias("src"), F.col("target").alias("dst"))
    reached = reached_from_any(used, entries.select(F.explode("render_chain").alias("node"))).select(F.col("node").alias("canonical_path"))
    return reached.agg(F.count("*").alias("reached")).crossJoin(nodes.agg(F.count("*").alias("total"))).crossJoin(unreached(nodes.select("canonical_path"), reached))


def visible_projects(projects: DataFrame, members: DataFrame, org_members: DataFrame) -> DataFrame:
    """Projects that a member sees: all but for the role MEMBER, who sees owned and assigned ones.

    projects: project_id, org_id, owner_id; members: project_id, user_id; org_members: org_id, user_id, role."""
    plain = _is_plain()
    all_of_them = projects.join(org_members.where(~plain), "org_id").select("user_id", "project_id")
    return all_of_them.unionByName(_own_projects(projects, members, org_members))


def visible_counts(projects: DataFrame, members: DataFrame, org_members: DataFrame) -> DataFrame:
    """user_id, projects: how many rows of `visible_projects` a member has, of the same tables.

    Who sees all of an organisation gets its number of projects; the projects aren't written out."""
    sizes = projects.groupBy("org_id").agg(F.count("*").alias("projects"))
    all_of_them = org_members.where(~_is_plain()).join(sizes, "org_id").select("user_id", "projects")
    own = _own_projects(projects, members, org_members).groupBy("user_id").agg(F.count("*").alias("projects"))
    return all_of_them.unionByName(own).groupBy("user_id").agg(F.sum("projects").alias("projects"))


def _is_plain():
    return F.coalesce(F.col("role"), F.lit("MEMBER")) == "MEMBER"


def _own_projects(projects: DataFrame, members: DataFrame, org_members: DataFrame) -> DataFrame:
    # a plain member meets owned and assigned projects by user and organisation, never all of an organisation
    inside = org_members.where(_is_plain()).select("org_id", "user_id")
    owned = projects.select("project_id", "org_id", F.col("owner_id").alias("user_id"))
    assigned = members.select("project_id", "user_id").join(projects.select("project_id", "org_id"), "project_id")
    return owned.unionByName(assigned).distinct().join(inside, ["org_id", "user_id"]).select("user_id", "project_id")


def at_least(role, least: str):
    """Whether a role ranks at or above another."""
    return F.array_position(F.array(*(F.lit(r) for r in S.ROLES)), role).between(1, S.ROLES.index(least) + 1)


def unique_slugs(names: DataFrame) -> DataFrame:
    """id, slug: in order of id, each takes the plain slug of its title or the first number that is free.

    names: id, title. All ask at once, first with their rank among equal titles; where a slug is
    asked for twice the smaller id gets it, the other one and those behind it of its title ask for
    later numbers, until every slug is unique."""
    w = Window.partitionBy("base").orderBy("id")
    rows = names.select("id", fn.slug(F.col("title")).alias("base")).withColumn("n", F.row_number().over(w) - 1)
    while True:
        asked = written(rows.withColumn("slug", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string")))), "slugs")
        twice = asked.groupBy("slug").agg(F.min("id").alias("holder"), F.count("*").alias("askers")).where("askers > 1").drop("askers")
        if twice.isEmpty():
            return asked.select("id", "slug")
        later = asked.join(twice, "slug", "left").withColumn("n", F.col("n") + F.when(F.col("holder") != F.col("id"), 1).otherwise(0))
        rank = F.row_number().over(w) - 1
        rows = later.withColumn("rank", rank).withColumn("n", F.col("rank") + F.max(F.col("n") - F.col("rank")).over(w)).select("id", "base", "n")


def invitation_valid(status, expires, email, user_email, now):
    """Whether an invitation can be accepted: pending, not expired, for this address in any case."""
    return (status == "PENDING") & (expires >= now) & (F.lower(email) == F.lower(user_email))
