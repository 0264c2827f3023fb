"""Communities by rounds, and buckets too large for a worker."""

import itertools
import random

from pyspark.sql import functions as F

from lattica.operators import cluster, communities


def cliques(k, n, seed=1):
    """k cliques of n nodes in a ring of single links, and two nodes without links."""
    r = random.Random(seed)
    links = [(c * n + a, c * n + b, 1.0 + r.random() / 10) for c in range(k) for a, b in itertools.combinations(range(n), 2)]
    return [*range(k * n), 900, 901], links + [(c * n, ((c + 1) % k) * n + 1, 0.5) for c in range(k)]


def frames(spark, nodes, links):
    return spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(links, "a long, b long, w double")


def test_cliques_are_found(spark):
    nodes, links = cliques(5, 6)
    v, e = frames(spark, nodes, links)
    got = {r["node"]: r["community"] for r in communities.communities(v, e).collect()}
    assert sorted(got) == nodes and got[900] == 900 and got[901] == 901
    assert all(got[c * 6 + i] == got[c * 6] for c in range(5) for i in range(6)) and len({got[c * 6] for c in range(5)}) == 5
    none = spark.createDataFrame([], "a long, b long, w double")
    assert {tuple(r) for r in communities.communities(v, none).collect()} == {(n, n) for n in nodes}


def test_modularity_never_falls_below_the_start(spark):
    r = random.Random(3)
    nodes = list(range(40))
    links = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), float(r.randint(1, 4))) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(90)) if a != b}.values())
    v, e = frames(spark, nodes, links)
    start = spark.createDataFrame([(n, n % 4) for n in nodes], "node long, community long")
    found = communities.communities(v, e, start=start)
    before, after = communities.modularity(e, start), communities.modularity(e, found)
    alone = cluster.louvain(nodes, {(a, b): w for a, b, w in links})
    one_worker = communities.modularity(e, spark.createDataFrame(list(alone.items()), "node long, community long"))
    assert after >= before and after > 0.8 * one_worker > 0


def test_many_nodes_join_a_community_in_one_round(spark, monkeypatch):
    links = [(h * 100, h * 100 + i, 1.0) for h in range(4) for i in range(1, 31)]
    v, e = frames(spark, sorted({n for a, b, _ in links for n in (a, b)}), links)
    tags = []
    kept = communities.written
    monkeypatch.setattr(communities, "written", lambda df, tag: tags.append(tag) or kept(df, tag))
    found = {r["node"]: r["community"] for r in communities.communities(v, e).collect()}
    assert all(found[b] == found[a] for a, b, _ in links) and len(set(found.values())) == 4
    assert tags.count("wanted") < 12  # one leaf of each hub a round would take 30


def test_a_bucket_beyond_a_worker_keeps_the_contract(spark):
    nodes, links = cliques(4, 9)
    buckets = spark.createDataFrame([(n, "big") for n in nodes] + [(n, "small") for n in range(1000, 1005)], "node_id long, bucket string")
    edges = spark.createDataFrame([(a, b, w, "BELONGS_TO_DOMAIN") for a, b, w in links], "source_id long, target_id long, weight double, edge_type string")
    rows = cluster.split_buckets(buckets, edges, 9, worker=60).collect()
    leaves = [r for r in rows if r["is_leaf"]]
    assert sorted(r["node_id"] for r in leaves) == sorted([*nodes, *range(1000, 1005)])
    sizes = {}
    for r in leaves:
        sizes[r["cluster_id"]] = sizes.get(r["cluster_id"], 0) + 1
    assert max(sizes.values()) == 9 and {r["cluster_id"] for r in leaves if r["node_id"] >= 1000} == {"small"}
    assert {r["node_id"] for r in rows if r["cluster_id"] == "big"} == set(nodes) and all(r["parent_id"] == "big" for r in leaves if r["node_id"] < 900)
    assert len({r["cluster_id"] for r in leaves if r["node_id"] < 36}) == 4
    chunks = cluster.split_buckets(buckets, edges.where("false"), 9, worker=20).where("is_leaf").groupBy("cluster_id").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in chunks) == 43 and max(r["n"] for r in chunks) <= 9


def test_slices_and_blocks_give_what_joins_give(spark, monkeypatch):
    r = random.Random(5)
    nodes = [f"n{i}" for i in range(300)]
    links = [(f"n{a}", f"n{b}", float(r.randint(1, 4))) for a, b in ((r.randrange(300), (r.randrange(10) * 30) + r.randrange(300) % 30) for _ in range(1200))]
    links += [(f"n{i}", f"n{i // 30 * 30}", 6.0) for i in range(300)] + [("n3", "n3", 2.0), ("n1", "n2", 0.0)]  # pairs repeat, some are loops
    v = spark.createDataFrame([(n,) for n in nodes], "node string")
    e = spark.createDataFrame(links, "a string, b string, w double")
    start = spark.createDataFrame([(n, f"s{i % 7}") for i, n in enumerate(nodes)], "node string, community string")
    tags, kept = [], communities.written
    monkeypatch.setattr(communities, "written", lambda df, tag: tags.append(tag) or kept(df, tag))
    reached = []
    for block in (1000, 70):
        monkeypatch.setattr(communities, "BLOCK", block)
        monkeypatch.setattr(communities, "LEAST_SLICE", 100)
        tags.clear()
        found, q, known = communities.compared(v, e, start=start)
        assert tags.count("wanted") < 9  # rounds of the first level; one worker holds the rest
        assert sorted(x["node"] for x in found.collect()) == sorted(nodes)
        assert abs(q - communities.modularity(e, found)) < 1e-9 and abs(known - communities.modularity(e, start)) < 1e-9
        reached.append(q)
    assert abs(reached[0] - reached[1]) < 1e-9 and reached[0] > 0.3
    monkeypatch.setattr(communities, "WORKER", 0)
    assert communities.compared(v, e, start=start)[1] > 0.9 * reached[0]
