"""Hot keys: shared words, aliases and directories."""

import random

from pyspark.sql import functions as F

from lattica.operators import cluster, infer, joins, resolve
from lattica.plans import registry
from lattica.sources import code


def test_paired_and_looked_up_equal_plain_joins(spark, monkeypatch):
    r = random.Random(1)
    left = spark.createDataFrame([(i, r.choice(["hot", "hot", None, f"k{i % 9}"])) for i in range(200)], "a long, k string")
    right = spark.createDataFrame([(i, r.choice(["hot", "hot", None, f"k{i % 7}"])) for i in range(150)], "b long, k string")
    got = sorted(map(tuple, joins.paired(left, right, "k", 50).select("a", "b", "k").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("a", "b", "k").collect()))
    known = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("a").alias("m"))
    for heavy in (1, 20, 10**9):
        monkeypatch.setattr(joins, "HEAVY", heavy)
        found = joins.looked_up(left, known, ["k"], F.col("n"), 200)
        assert sorted(map(tuple, found.select("a", "m").collect()), key=str) == sorted(map(tuple, left.join(known, "k", "left").select("a", "m").collect()), key=str)


def test_one_word_in_all_files_stays_linear(spark):
    files = spark.range(100_000).select(F.col("id").alias("node_id"), (F.col("id") % 2).cast("int").alias("tier"), F.array(F.lit("user"), F.concat(F.lit("w"), F.col("id") % 1000)).alias("tokens"))
    got = infer.naming_groups(files)
    assert got.where("token = 'user'").first()["links"] == 50_000**2 and got.count() == 1  # a number has one parity
    few = files.where("node_id < 60").withColumn("tokens", F.array(F.lit("user"), F.concat(F.lit("w"), F.col("node_id") % 3)))
    groups = {r["token"]: r["links"] for r in infer.naming_groups(few).collect()}
    pairs = infer.naming_edges(few).select(F.explode("called_names").alias("t")).groupBy("t").count().collect()
    assert {r["t"]: r["count"] for r in pairs} == groups


def test_thousands_of_aliases_in_one_scope(spark):
    n = 10_000
    aliases = spark.range(n).select(F.lit("web").alias("scope"), F.concat(F.lit("@p"), "id").alias("alias"), F.concat(F.lit("web/lib"), "id").alias("dir"), F.col("id").cast("int").alias("ord"))
    aliases = aliases.unionByName(spark.createDataFrame([("web", "", "web/any", n), (".", "@", "top", 0)], aliases.schema))
    imports = spark.range(20_000).select(F.concat(F.lit("web/f"), "id", F.lit(".ts")).alias("source_path"), F.concat(F.lit("@p"), F.col("id") % 20, F.lit("/x")).alias("spec"))
    imports = imports.unionByName(spark.createDataFrame([("a.ts", "@p1/x"), ("web/z.ts", "other/y")], imports.schema))
    none = spark.createDataFrame([], "package string, dir string")
    found = resolve.import_bases(imports, aliases, none)
    plan = found._jdf.queryExecution().toString()
    assert "startswith(spec, alias" not in plan.lower() and "NestedLoop" not in plan
    got = {(r["source_path"], r["spec"]): r["base"] for r in found.collect()}
    assert len(got) == 20_002 and got["a.ts", "@p1/x"] == "top/p1/x" and got["web/z.ts", "other/y"] == "web/any/other/y"
    assert got["web/f7.ts", "@p7/x"] == "web/lib7/x" and got["web/f15.ts", "@p15/x"] == "web/lib1/5/x"  # the first alias that begins it


def test_workspace_rules_meet_directories_by_their_literal_part(spark):
    names = {"pkgs/ui": "ui", "pkgs/deep/er": "er", "apps/web/x": "web", "tools": "tools", "pkgs": "pkgs", ".": "root"}
    rows = [((f"{d}/" if d != "." else "") + "package.json", '{"name": "%s"%s}' % (n, ', "workspaces": ["pkgs/*", "apps/**", "tools", "*/deep/er"]' if d == "." else "")) for d, n in names.items()]
    manifests = spark.createDataFrame(rows, "canonical_path string, source string")
    got = {r["package"]: r["dir"] for r in code.workspace_packages(manifests, manifests.where("false")).collect()}
    assert got == {"ui": "pkgs/ui", "er": "pkgs/deep/er", "web": "apps/web/x", "tools": "tools"}


def brute(small, every):
    out = {}
    for b in small:
        agree = {o: sum(x == y for x, y in zip(b.split("/"), o.split("/"), strict=False)) for o in every if o != b}
        best = max(agree.values(), default=0)
        if agree:
            out[b] = min(o for o in agree if agree[o] == best)
    return out


def test_closest_directory_equals_brute_force(spark):
    r = random.Random(4)
    every = sorted({"/".join(["src", *(r.choice("abc") for _ in range(r.randint(0, 4)))][r.randint(0, 1) :]) for _ in range(120)} - {""} | {"/".join("abcdefghijklm"), "/".join("abcdefghijkxm"), "x/y"})
    df = spark.createDataFrame([(b,) for b in every], "bucket string")
    got = {x["bucket"]: x["target"] for x in cluster.closest_directory(df, df).collect()}
    assert got == brute(every, every)
    one = spark.createDataFrame([("a",)], "bucket string")
    assert cluster.closest_directory(one, one).collect() == []


def test_siblings_are_paired_by_as_many_tasks_as_pairs_need(spark):
    f = spark.range(1500).selectExpr("id as node_id", "case when id < 1200 then 'd' else concat('d', id div 2) end as dir").coalesce(1)
    got = infer.sibling_edges(f).withColumn("task", F.spark_partition_id())
    n = got.agg(F.count("*").alias("n"), F.countDistinct("source_id", "target_id").alias("d"), F.countDistinct("task").alias("t")).first()
    assert (n["n"], n["d"]) == (1200 * 1199 + 300, 1200 * 1199 + 300) and n["t"] > 1
    assert got.where("source_id < 1200").select("task").distinct().count() == 2  # 1,440,000 pairs of one directory


def test_naming_pairs_are_made_once_and_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(infer, "MEMBERS", 4, raising=False)
    monkeypatch.setattr(infer, "RUN", 40, raising=False)
    r = random.Random(2)
    rows = [(n, r.choice([0, 1, 2, None]), r.sample(["user", "order", "", "cart", None], r.randint(0, 3))) for n in [*range(70), *range(10), None, None]]  # some in two tiers
    files = spark.createDataFrame(rows, "node_id long, tier int, tokens array<string>")
    want = {}
    for a, s, x in rows:
        for b, t, y in rows:
            if s is not None and t is not None and s < t and (both := {*x} & {*y} - {None}):
                want.setdefault((a, b), set()).update(both)
    got = infer.naming_edges(files)
    made = [tuple(p) for p in got.collect()]
    assert sorted(made, key=str) == sorted(((a, b, sorted(w)) for (a, b), w in want.items()), key=str)
    above = got._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert "Aggregate" not in above and "Repartition" not in above


def test_naming_pairs_query_shows_words_before_pairs_are_written_out(spark, tmp_path):
    parts = [(i, f"{a} {b}", f"{t} X") for i, (a, b, t) in enumerate([("red", "ring", "ECONOMY"), ("red", "bolt", "LARGE"), ("ring", "red", "SMALL"), ("red", "red", "LARGE")])]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string").selectExpr("*", "'b' as p_brand", "1 as p_size", "1.0 as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    got = registry.load()[0]["naming_pairs"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(0, 1, "red"), (0, 2, "red,ring"), (0, 3, "red"), (1, 2, "red"), (3, 2, "red")}
    above, below = got._jdf.queryExecution().optimizedPlan().toString().split("Join Inner", 1)
    assert "Aggregate" not in above and above.count("Generate explode") == 2 and "array_join" in above.split("Generate explode")[-1]
