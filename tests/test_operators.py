"""Hand-computed cases of functions and operators."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.functions import scalar as fn
from lattica.operators import analytics, cluster, domains, edges, graph, history, infer, metrics, resolve
from lattica.streaming import progress


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*(F.col(c) for c in df.columns)).alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [
    ("http://localhost:5000/api/Auth/login?x=1", "/api/auth/login"), ("/api/users/:id", "/api/users/*"), ("/api/users/${id}", "/api/users/*"), ("/api/users/42", "/api/users/*"), ("api/x", None), ("", None), ("*/auth", None), (None, None), ("//h/a#b", "/a"), ("https://h", "/"), (" /A/[id]/{x}/ ", "/a/*/*"),
])
def test_normalize_url(spark, raw, want):
    assert one(spark, fn.normalize_url, raw) == want


@pytest.mark.parametrize(("a", "b", "want"), [("/a/*/c", "/a/b/c", True), ("/a/b", "/a/b/c", False), ("/", "/", True)])
def test_urls_match(spark, a, b, want):
    assert one(spark, fn.urls_match, a, b) is want


@pytest.mark.parametrize(("path", "want"), [("app/(dashboard)/students/[studentId]/page.tsx", "/students/:studentId"), ("app/page.tsx", "/"), ("lib/page.tsx", None), ("app/@m/x/route.ts", "/x"), ("app/x/view.tsx", None)])
def test_page_url(spark, path, want):
    assert one(spark, fn.page_url, path) == want


@pytest.mark.parametrize(("path", "want"), [("app/api/auth/login/route.ts", "/api/auth/login"), ("pages/api/x/index.ts", "/api/x"), ("src/a.ts", None), ("app/(g)/[id]/route.js", "/*")])
def test_route_url(spark, path, want):
    assert one(spark, fn.route_url, path) == want


def test_paths_and_tokens(spark):
    assert [one(spark, fn.canonical_bucket, p) for p in ("apps/web/a/x.ts", "src/a.ts", "x.ts")] == ["apps/web", "src/a.ts", "x"]
    assert sorted(one(spark, fn.tokenize, "src/userProfile/HTTPServer.ts")) == ["http", "profile", "server", "user"]
    assert [one(spark, fn.file_layer, p) for p in ("user.controller.js", "models/user.js", "x.js")] == [1, 4, None]
    assert [one(spark, fn.event_name, e) for e in ("click", "user.created", "save", "userCreated", "two words")] == [None, "user.created", None, "usercreated", None]
    assert [one(spark, fn.package_domain, d) for d in ("next-auth/react", "@stripe/stripe-js/pure", "lodash")] == ["AUTHENTICATION", "PAYMENTS", None]
    assert one(spark, fn.preprocess, "// hello const world\nlet a = 1 /* b */", "src/my-file.ts") == "my file src hello world b"
    assert [one(spark, fn.repository_url, u) for u in ("https://github.com/a/b/", "https://github.com/a/b.git", "ftp://x")] == ["https://github.com/a/b.git", "https://github.com/a/b.git", None]


E = "source_id long, target_id long, weight double, edge_type string, binding string, called_names array<string>, is_dead_import boolean, is_synthetic boolean, source_line int, target_line int, seq long"


def test_edge_merge(spark):
    rows = [(1, 2, 1.0, "BELONGS_TO_DOMAIN", "x", ["a"], True, False, None, None, 1), (1, 2, 0.0, "RENDERS", "y", ["b"], False, False, 7, None, 2), (3, 4, 1.0, "BELONGS_TO_DOMAIN", "", [], False, False, 1, None, 1), (3, 4, 0.4, "BELONGS_TO_DOMAIN", "", None, False, True, 2, None, 2)]
    got = {r["source_id"]: r for r in edges.merge_edges(spark.createDataFrame(rows, E), ["seq"]).collect()}
    a, b = got[1], got[3]
    assert (a["edge_type"], a["weight"], a["called_names"], a["is_dead_import"], a["source_line"], a["binding"]) == ("RENDERS", 0.0, ["a", "b"], False, 7, "y")
    assert (round(b["weight"], 9), b["is_synthetic"], b["source_line"]) == (1.4, False, 1)


def test_move_preview(spark):
    m = spark.createDataFrame([("1", "c1"), ("2", "c1"), ("3", "c2"), ("4", "c2")], "node_id string, cluster_id string")
    e = spark.createDataFrame([("1", "3", 1.0), ("1", "4", 1.0), ("3", "4", 1.0), ("1", "2", 0.0)], "source_id string, target_id string, weight double")
    r = metrics.move_preview(m, e, "1", "c2").first()
    want = {"modularity": (-0.2222, 0.0), "cohesion": (33.3333, 100.0), "coupling": (66.6667, 0.0), "size_balance": (100.0, 81.1278), "placement": (0.0, 100.0), "quality": (32.2917, 77.9596)}
    assert {k: (r[f"{k}_before"], r[f"{k}_after"]) for k in want} == want and r["quality_delta"] == 45.6679 and r["verdict"] == "IMPROVES"
    assert (r["from_cluster"], r["source_before"], r["source_after"], r["target_before"], r["target_after"]) == ("c1", 2, 1, 2, 3)
    assert [tuple(x) for x in r["reasons"]] == [("placement", "up", 100.0), ("modularity", "up", 0.2222), ("cohesion", "up", 66.6667), ("size_balance", "down", -18.8722)]
    lone = metrics.move_preview(m, e.where("source_id = '9'"), "1", "c2").first()
    assert tuple(lone["reasons"][0]) == ("placement", "none", None) and lone["verdict"] == "WORSENS"


def test_propagation_on_a_chain(spark):
    e = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 1.0), ("C", "D", 1.0)], "src string, dst string, weight double")
    s = spark.createDataFrame([("A", "X", 0.90), ("D", "Y", 0.75)], "node string, domain string, score double")
    got = {(r["node"], r["domain"]): round(r["score"], 4) for r in graph.propagate(e, s, 30, 0.85, 1e-4).collect()}
    assert (got["B", "X"], got["B", "Y"], got["C", "Y"], got["C", "X"], got["A", "X"]) == (0.4668, 0.1653, 0.3890, 0.1984, 0.90)


def test_components_and_reach(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 3), (9, 8), (7, 7), (None, 1)], "src long, dst long")
    got = {r["node"]: r["component"] for r in graph.connected_components(e).collect()}
    assert got == {5: 3, 4: 3, 3: 3, 9: 8, 8: 8}
    assert graph.connected_components(e.where("false")).count() == 0
    reach = graph.reachable(e.na.drop(), spark.createDataFrame([(5,), (9,)], "root long"))
    assert {(r["root"], r["node"]) for r in reach.collect()} == {(5, 5), (5, 4), (5, 3), (9, 9), (9, 8)}


def test_components_of_a_long_chain_and_a_star(spark):
    n = 300
    e = spark.range(n).selectExpr("id as src", "id + 1 as dst").union(spark.range(1000, 1500).selectExpr("id as src", "2000 as dst"))
    got = {r["component"]: r["n"] for r in graph.connected_components(e).groupBy("component").agg(F.count("*").alias("n")).collect()}
    assert got == {0: n + 1, 1000: 501}


def test_cluster_domains(spark):
    rows = [("a", "X", 0.9), ("a", "X", 0.75), ("a", "X", 0.5), ("a", "Y", 0.9), ("a", None, None), ("b", "X", 0.9), ("b", "X", 0.9), ("b", "Y", 0.9), ("b", "Y", 0.9)]
    got = domains.cluster_domains(spark.createDataFrame(rows, "cluster_id string, domain string, confidence double")).collect()
    assert [(r["cluster_id"], r["domain"], r["confidence"]) for r in got] == [("a", "X", 0.43)]


def test_shared_dependency(spark):
    n = spark.range(10).selectExpr("id as node_id")
    e = spark.range(9).selectExpr("id as source_id", "9L as target_id", "'BELONGS_TO_DOMAIN' as edge_type", "1.0D as weight")
    got = edges.shared_dependencies(n, e).first()
    assert (got["node_id"], got["centrality_score"], got["is_god_file"]) == (9, 0.9, True)


def test_naming_edges(spark):
    f = spark.createDataFrame([(i, p) for i, p in enumerate(["routes/user.js", "controllers/user.js", "models/order.js"])], "node_id long, p string")
    f = f.select("node_id", fn.file_layer(F.col("p")).alias("tier"), fn.domain_tokens(F.col("p")).alias("tokens"))
    got = infer.naming_edges(f)
    assert [(r["source_id"], r["target_id"]) for r in got.collect()] == [(0, 1)]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_naming_edges_query_pairs_every_shared_word(spark, tmp_path):
    from lattica.plans import registry

    kinds = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    rows = [(i, f"{'red blue tan lime'.split()[i % 4]} {'sky sea red'.split()[i % 3]}", f"{kinds[i % 6]} X", f"Brand#{i % 5}", i % 7, 1.0) for i in range(40)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    want = set()
    for i, a, s, *_ in rows:
        for j, b, t, *_ in rows:
            if "STANDARD" not in s + t and s < t and (both := {*a.split()} & {*b.split()}):
                want.add((i, j, ",".join(sorted(both))))
    got = [(r["source_id"], r["target_id"], r["called_names"]) for r in registry.load()[0]["naming_pairs"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {tuple(r) for r in registry.load()[0]["naming_edges"](spark, str(tmp_path)).collect()} == want
    groups = registry.load()[0]["naming_groups"](spark, str(tmp_path)).collect()
    assert sum(r["links"] for r in groups) == sum(len(words.split(",")) for *_, words in want) and len({(r["token"], r["source_tier"], r["target_tier"]) for r in groups}) == len(groups)


def test_state_edges_and_their_guard(spark):
    rows = [(1, 0, "m.ts", True, False), (2, 0, "m.ts", False, True)] + [(100 + i, 9, "big.ts", True, False) for i in range(13)] + [(200 + i, 9, "big.ts", False, True) for i in range(12)]
    i = spark.createDataFrame(rows, "source_id long, target_id long, label string, provides boolean, consumes boolean")
    assert [tuple(r) for r in infer.state_edges(i, i.select("source_id", "target_id")).collect()] == [(1, 2, "m.ts")]


def test_url_match_join_query_gives_every_page_a_route(spark, tmp_path):
    from lattica.plans import registry

    rows = [(i, f"http://h/{'abc'[i % 3]}" + f"/x{i % 4}" * (i % 5 != 4) + "/y" * (i % 7 == 6)) for i in range(60)] + [(60, "http://h/*/x1"), (61, "http://h/"), (62, "http://h/7/x2"), (63, None)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    star = lambda s: "*" if s.isdigit() else s
    path = {i: [star(s) for s in url[len("http://h/") :].split("/") if s] for i, url in rows if url}
    want = {}
    for i, p in path.items():
        route = [x for x in [(p or [""])[0], "*"] if x] if i % 2 == 0 else ["*", p[1]] if len(p) > 1 else None
        if route:
            n = sum(len(q) == len(route) and all(a == b or "*" in (a, b) for a, b in zip(q, route, strict=True)) for q in path.values())
            want |= {i: n} if n else {}
    got = {r["server"]: r["clients"] for r in registry.load()[0]["url_match_join"](spark, str(tmp_path)).collect()}
    assert got == want and {i % 10 for i in got} > {0, 1}


def test_ancestor_layout_query_takes_layouts_of_any_size(spark, tmp_path):
    from lattica.plans import registry

    rows = [(i, f"a{i % 3} b", f"T{i % 2}", f"B{i % 2}", 1 + i % 50, 1.0) for i in range(4, 40)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    dirs = {i: ["src", kind.lower(), name.replace(" ", "-"), brand] for i, name, kind, brand, *_ in rows}
    first = {}
    for i in sorted(dirs):
        first.setdefault(tuple(dirs[i][: 2 + i % 2]), i)
    want = {(next(first[tuple(d[:n])] for n in (3, 2, 1) if tuple(d[:n]) in first), i) for i, d in dirs.items()}
    got = {(r["source_id"], r["target_id"]) for r in registry.load()[0]["ancestor_layout"](spark, str(tmp_path)).collect()}
    assert got == {(a, b) for a, b in want if a != b}


def test_url_pairs_use_an_equality(spark):
    c = spark.createDataFrame([(1, "/a/*/c"), (2, "/*/x"), (3, "/q"), (4, "/")], "id long, url string")
    s = spark.createDataFrame([(7, "/a/b/c"), (8, "/y/x"), (9, "/*"), (10, "/")], "id long, url string")
    got = infer.url_pairs(c, s)
    assert {(r["client"], r["server"]) for r in got.collect()} == {(1, 7), (2, 8), (3, 9), (4, 10)}
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_delta_and_ownership(spark):
    p = spark.createDataFrame([("f1", "c1"), ("f2", "c1"), ("f3", "c2")], "path string, cluster_id string")
    n = spark.createDataFrame([("f1", "c1"), ("f2", "c2"), ("f4", "c2")], "path string, cluster_id string")
    d = history.delta_document(history.snapshot_delta(p, n), p, n).first()
    assert (d["added_nodes"], d["removed_nodes"], d["modified_nodes"]) == (["f4"], ["f3"], ["f2"])
    lines = spark.createDataFrame([("p", a) for a in "aaaaaabbb"] + [("p", None)], "path string, author string")
    got = {r["author"]: (r["lines"], r["percentage"], r["is_primary"]) for r in history.ownership(lines).collect()}
    assert got == {"a": (6, 66.7, True), "b": (3, 33.3, False)}


def test_upsert_conflicts(spark):
    b = spark.createDataFrame([("f1", "c1", 2)], "k string, value string, version long")
    for expected, status in ((1, "CONFLICT"), (2, "UPDATED"), (None, "UPDATED")):
        c = spark.createDataFrame([("f1", "c2", expected)], "k string, value string, expected long")
        assert history.upsert(b, c, "k").first()["status"] == status
    c = spark.createDataFrame([("f2", "c2", None), ("f3", "c2", 0)], "k string, value string, expected long")
    assert {r["k"]: r["status"] for r in history.upsert(b, c, "k").collect()} == {"f1": "UNCHANGED", "f2": "INSERTED", "f3": "CONFLICT"}


def test_visible_projects_and_roles(spark):
    p = spark.createDataFrame([(1, 1, 5), (2, 1, 6), (3, 1, 7)], "project_id long, org_id long, owner_id long")
    m = spark.createDataFrame([(2, 5)], "project_id long, user_id long")
    o = spark.createDataFrame([(1, 5, "MEMBER"), (1, 8, "OWNER")], "org_id long, user_id long, role string")
    got = {(r["user_id"], r["project_id"]) for r in analytics.visible_projects(p, m, o).collect()}
    assert got == {(5, 1), (5, 2), (8, 1), (8, 2), (8, 3)}
    assert [one(spark, lambda r: analytics.at_least(r, "ADMIN"), x) for x in ("OWNER", "ADMIN", "MEMBER", "none")] == [True, True, False, False]


def test_visible_counts_write_no_organisation_out(spark):
    p = spark.range(300).selectExpr("id as project_id", "id % 2 as org_id", "1000 + id % 5 as owner_id")
    m = spark.createDataFrame([(2, 1001), (3, 1001), (1, 1001)], "project_id long, user_id long")
    o = spark.createDataFrame([(i % 2, i, "ADMIN" if i < 300 else None) for i in [*range(300), *range(1000, 1005)]], "org_id long, user_id long, role string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    got = analytics.visible_counts(p, m, o)
    assert rows(got) == rows(analytics.visible_projects(p, m, o).groupBy("user_id").agg(F.count("*").alias("projects")))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [org_id" in plan  # the organisation's projects are counted before they meet its members


def test_slugs_and_even_chunks(spark):
    s = spark.createDataFrame([(1, "My Org"), (2, "My Org!")], "id long, title string")
    assert {r["id"]: r["slug"] for r in analytics.unique_slugs(s).collect()} == {1: "my-org", 2: "my-org-1"}
    titles = ["x", "x 1", "x", "x", "x 1", "x 2", "x-1-1", "y 1", "y", "y"]
    taken, want = set(), {}
    for i, title in enumerate(titles):
        base = title.replace(" ", "-")
        want[i] = next(c for c in [base, *(f"{base}-{n}" for n in range(1, 20))] if c not in taken)
        taken.add(want[i])
    got = analytics.unique_slugs(spark.createDataFrame(list(enumerate(titles)), "id long, title string"))
    assert {r["id"]: r["slug"] for r in got.collect()} == want
    rows = cluster.split(list(range(65)), {}, 30, "b")
    assert [len(v) for _, _, v in rows] == [30, 30, 5]


def test_louvain_splits_two_cliques():
    links = {(a, b): 1.0 for g in (range(20), range(20, 40)) for a in g for b in g if a < b} | {(0, 20): 0.1}
    found = cluster.louvain(list(range(40)), links)
    assert len(set(found.values())) == 2 and all(found[i] == found[0] for i in range(20))
    rows = cluster.split(list(range(40)), links, 30, "c")
    parents = {p for _, p, _ in rows if p}
    leaves = [v for c, _, v in rows if c not in parents]
    assert sorted(x for v in leaves for x in v) == list(range(40)) and max(map(len, leaves)) <= 30


def test_bucket_split_keeps_every_node_once(spark):
    b = spark.range(100).selectExpr("id as node_id", "case when id < 80 then 'x' else 'y' end as bucket")
    e = spark.range(99).selectExpr("id as source_id", "id + 1 as target_id", "1.0D as weight", "'BELONGS_TO_DOMAIN' as edge_type")
    found = cluster.split_buckets(b, e)
    leaf = cluster.leaves(found)
    assert leaf.count() == 100 and leaf.select("node_id").distinct().count() == 100
    assert leaf.groupBy("cluster_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= 30


def test_merging_small_buckets(spark):
    b = spark.createDataFrame([(1, "a/x"), (2, "a/x"), (3, "a/y"), (4, "a/y"), (5, "a/y"), (6, "b/z"), (7, "a/q")], "node_id long, bucket string")
    e = spark.createDataFrame([(1, 3, 2.0, "BELONGS_TO_DOMAIN"), (1, 6, 1.0, "BELONGS_TO_DOMAIN")], "source_id long, target_id long, weight double, edge_type string")
    got = {r["node_id"]: r["bucket"] for r in cluster.merge_small(b, e).collect()}
    assert got[1] == got[2] == got[3] == "a/y" and set(got) == set(range(1, 8))


def test_merging_leaves_no_small_bucket_while_there_is_another(spark):
    b = spark.createDataFrame([(1, "a/x"), (2, "b/y"), (3, "c/z"), (4, "c/z"), (5, "q/y"), (6, "solo")], "node_id long, bucket string")
    none = spark.createDataFrame([], "source_id long, target_id long, weight double, edge_type string")
    got = cluster.merge_small(b, none)
    sizes = [r["n"] for r in got.groupBy("bucket").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 6 and (min(sizes) >= 3 or len(sizes) == 1)
    assert cluster.merge_small(b.where("node_id = 1"), none).first()["bucket"] == "a/x"
    small = spark.createDataFrame([("p/q/r",), ("m/n",)], "bucket string")
    every = spark.createDataFrame([("p/q/r",), ("p/x/r",), ("p/q/z",), ("a",), ("m/n",)], "bucket string")
    assert {r["bucket"]: r["target"] for r in cluster.closest_directory(small, every).collect()} == {"p/q/r": "p/q/z", "m/n": "a"}


def test_vectors_place_what_edges_do_not(spark):
    v = spark.createDataFrame([(i, [1.0, 0.1 * i] if i < 5 else [0.9 - 0.1 * i, 1.0]) for i in range(10)], "node_id long, v array<double>")
    b = spark.createDataFrame([(i, "a" if i < 4 else "alone" if i == 4 else "b" if i < 9 else "last") for i in range(10)], "node_id long, bucket string")
    none = spark.createDataFrame([], "source_id long, target_id long, weight double, edge_type string")
    merged, placed = cluster.merged_small(b, none, vectors=v)
    got = {r["node_id"]: r["bucket"] for r in merged.collect()}
    assert got[4] == "a" and got[9] == "b"
    assert {r["node_id"]: r["member"] for r in placed.collect()} == {4: 3, 9: 8}
    e = cluster.semantic_edges(placed, none).collect()
    assert {(r["source_id"], r["target_id"], r["edge_type"], r["weight"]) for r in e} == {(4, 3, "SEMANTIC_SIMILARITY", 0.2), (9, 8, "SEMANTIC_SIMILARITY", 0.2)}
    heads, by = cluster.reassigned(b.where("bucket = 'last'").select("node_id"), b.where("bucket <> 'last'"), v)
    assert {r["node_id"]: r["bucket"] for r in heads.collect()}[9] == "b" and by.count() == 1
    alone, by = cluster.absorbed(b, none, v)
    assert {r["node_id"]: r["bucket"] for r in alone.collect()}[4] == "a" and {r["node_id"] for r in by.collect()} == {4, 9}
    stay, by = cluster.absorbed(b, none)
    assert {r["node_id"]: r["bucket"] for r in stay.collect()}[4] == "alone" and by is None


def test_nearest_beyond_the_broadcast_and_in_slices(spark):
    from lattica.operators import vectors

    v = spark.createDataFrame([(i, i % 3, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "id long, grp long, v array<double>")
    c = vectors.centroids(v.withColumn("k", F.col("id") % 11), "k")
    rows = lambda d: sorted((r["id"], r["best"], round(r["similarity"], 9)) for r in d.collect())
    assert rows(vectors.nearest_centroid(v, c, "k")) == rows(vectors.nearest_centroid(v, c, "k", bound=0, block=4))
    assert rows(vectors.nearest_member(v, v)) == rows(vectors.nearest_member(v, v, block=3))
    model = lambda texts: [[len(t), 1] for t in texts]
    got = vectors.embedded(spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string"), model)
    assert {r["id"]: r["v"] for r in got.collect()} == {1: [2.0, 1.0], 2: [0.0, 1.0]}


def test_nearest_members_by_matrix_products_equal_the_cosines(spark):
    from lattica.operators import vectors

    r = random.Random(5)
    usual = [[float(r.randint(-3, 3)) for _ in range(8)] for _ in range(60)]
    usual += [[2 * x for x in v] for v in usual[:9]] + usual[:9]  # equals and multiples tie
    odd = [None, [0.0] * 8, [1.0, None] * 4, [], [float("nan")] * 8, [1e-120] * 8, [1e200] + [0.0] * 7, [1.0, 2.0]]
    rows = lambda d: sorted(str(tuple(r)) for r in d.collect())
    for some in (usual, usual + odd):
        v = spark.createDataFrame([(i, i % 2, x) for i, x in enumerate(some)], "id long, grp long, v array<double>")
        pairs = v.join(v.toDF("best", "grp", "w"), "grp").where("id <> best").withColumn("s", fn.cosine(F.col("v"), F.col("w")))
        want = pairs.groupBy("id").agg(F.min_by(F.struct("best", "s"), F.struct(-F.col("s"), F.col("best"))).alias("r")).select("id", "r.best", "r.s")
        got = vectors.nearest_member(v, v, block=16)
        assert rows(got) == rows(want)
    assert "CoGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString()


def test_louvain_goes_on_until_nothing_moves():
    n = 400
    links = {(i, i + 1): 1.0 + (i % 2) * 1e-3 for i in range(n - 1)}
    for refine in (False, True):
        found = cluster.communities(list(range(n)), links, refine=refine)
        assert set(found) == set(range(n)) and 5 < len(set(found.values())) < 60
        for c in set(found.values()):  # a chain's communities are connected
            mine = sorted(v for v in found if found[v] == c)
            assert mine == list(range(mine[0], mine[-1] + 1))


def test_components_of_a_chain_of_1100_links(spark):
    e = spark.range(1100).selectExpr("id as src", "id + 1 as dst")
    assert graph.connected_components(e).where("component <> 0").count() == 0


def test_resolution_order(spark):
    reg = spark.createDataFrame([("src/a.ts",), ("src/a/index.js",), ("src/lib/x.ts",), ("pkgs/ui/src/button.tsx",), ("pkgs/ui/button.tsx",), ("y.js",)], "canonical_path string")
    imports = spark.createDataFrame([("src/main.ts", "./a"), ("src/lib/b.ts", "../../y"), ("src/main.ts", "@/x"), ("src/main.ts", "@acme/ui/button"), ("src/main.ts", "lodash")], "source_path string, spec string")
    aliases = spark.createDataFrame([(".", "@", "src/lib", 0)], "scope string, alias string, dir string, ord int")
    packages = spark.createDataFrame([("@acme/ui", "pkgs/ui")], "package string, dir string")
    got = {r["spec"]: r["resolved"] for r in resolve.resolve(imports, reg, aliases, packages).collect()}
    assert got == {"./a": "src/a.ts", "../../y": "y.js", "@/x": "src/lib/x.ts", "@acme/ui/button": "pkgs/ui/src/button.tsx"}


def test_entry_points_and_landing(spark):
    n = spark.createDataFrame([(p, ["express"] if p == "server.js" else None, "c", "D") for p in ("app/layout.tsx", "app/login/page.tsx", "app/in/[t]/page.tsx", "app/dash/layout.tsx", "app/dash/page.tsx", "lib/AuthGuard.ts", "lib/a.ts", "lib/b.ts", "server.js", "lib/lost.ts")], "canonical_path string, external_dependencies array<string>, cluster_id string, domain string")
    e = spark.createDataFrame([("app/dash/layout.tsx", "lib/AuthGuard.ts"), ("app/login/page.tsx", "lib/a.ts"), ("app/in/[t]/page.tsx", "lib/a.ts"), ("app/in/[t]/page.tsx", "lib/b.ts"), ("server.js", "lib/b.ts")], "source string, target string").selectExpr("*", "'BELONGS_TO_DOMAIN' as type", "false as is_synthetic")
    found = analytics.entry_points(n, e)
    got = {r["file"]: r for r in found.collect()}
    assert got["app/dash/page.tsx"]["auth_state"] == "protected" and got["app/dash/page.tsx"]["is_landing"] and got["app/dash/page.tsx"]["render_chain"] == ["app/layout.tsx", "app/dash/layout.tsx", "app/dash/page.tsx"]
    assert got["app/login/page.tsx"]["is_landing"] and not got["app/in/[t]/page.tsx"]["is_landing"] and got["server.js"]["kind"] == "server"
    c = analytics.coverage(n, e, found).first()
    assert (c["total"], c["unreached_count"], c["unreached_sample"]) == (10, 1, ["lib/lost.ts"])


def test_progress_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("select id % 5 as task, concat('s', id % 3) as stage, timestamp_seconds(id * 60) as ts, id as seq from range(50)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = progress.latest_stream(stream, "latest_progress", f"{tmp_path}/check")
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("latest_progress").collect())) == sorted(map(tuple, progress.latest(rows).collect()))
    runs = progress.error_runs(spark.sql("select 1 as task, id in (2, 3, 4, 7) as bad, timestamp_seconds(id) as ts, id as seq from range(10)")).first()
    assert (runs["longest_run"], runs["gave_up"]) == (3, False)
    assert progress.poll_schedule(spark.sql("select id % 2 as task, id = 3 as terminal from range(20)"), 10).where("timed_out").count() == 1


def test_windowed_counts_drop_late_rows(spark, tmp_path):
    w = progress.windowed(spark.sql("select 's' as stage, timestamp_seconds(id * 1800) as ts from range(4)"))
    assert sorted(r["n"] for r in w.collect()) == [2, 2]
