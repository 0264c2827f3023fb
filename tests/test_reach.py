"""Components and reach against plain search."""

import random

from pyspark.sql import functions as F

from lattica.operators import reach


def plain(edges, nodes):
    out = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for a, b in edges:
                if a == todo[-1] and b not in seen and b is not None:
                    seen.add(b)
                    todo.insert(0, b)
            todo.pop()
        out[n] = seen
    return out


def graph(seed):
    r = random.Random(seed)
    edges = [(r.randrange(30), r.randrange(30)) for _ in range(45)]
    edges += [(40 + i, 41 + i) for i in range(12)] + [(60 + i, 60 + (i + 1) % 9) for i in range(9)] + [(52, 60), (60, 0), (5, 5), (70, 71), (71, 70), (None, 3), (80, None)]
    return edges


def test_components_and_counts_equal_plain_search(spark):
    for seed in (1, 2):
        edges = graph(seed)
        df = spark.createDataFrame(edges, "src long, dst long")
        nodes = {x for e in edges if None not in e for x in e}
        want = plain([e for e in edges if None not in e], nodes)
        found = {r["node"]: r["component"] for r in reach.strong_components(df).collect()}
        assert found.keys() == nodes
        for a in nodes:
            assert found[a] in want[a] and a in want[found[a]]
            assert {b for b in nodes if found[b] == found[a]} == {b for b in want[a] if a in want[b]}
    lone = spark.createDataFrame([(999,)], "node long")
    got = reach.reach_sets(df, lone)
    counts = {r["root"]: r["reached"] for r in reach.reach_counts(got, spark.createDataFrame([(n,) for n in [*nodes, 999]], "root long")).collect()}
    assert counts == {n: len(s) for n, s in want.items()} | {999: 1}
    groups = [(1, 60), (1, 70), (2, 45), (2, 46), (3, 999)]
    either = {r["group"]: r["reached"] for r in reach.union_counts(got, spark.createDataFrame(groups, "group long, root long")).collect()}
    assert either == {1: len(want[60] | want[70]), 2: len(want[45]), 3: 1}
    some = reach.reached_from_any(df, spark.createDataFrame([(60,), (70,)], "node long"))
    assert {r["node"] for r in some.collect()} == want[60] | want[70]


def test_no_pairs_of_a_large_component(spark):
    """40,000 nodes that all reach each other: one set of bitmaps, not 1.6 billion pairs."""
    n = 40_000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") * 3 + 1) % n).alias("dst"))
    star = spark.range(1, n).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    back = star.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    got = reach.reach_sets(ring.unionByName(star).unionByName(back))
    assert got.sets.count() == 2
    counts = reach.reach_counts(got, spark.range(0, n, 100).select(F.col("id").alias("root")))
    assert counts.count() == 400 and {r["reached"] for r in counts.select("reached").distinct().collect()} == {n}


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src long, dst long")
    got = reach.reach_sets(none)
    assert got.sets.isEmpty() and reach.strong_components(none).isEmpty()
    assert reach.reach_counts(got, spark.createDataFrame([(1,)], "root long")).isEmpty()
