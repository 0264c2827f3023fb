"""Business domains: seeds, classification and cluster domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica import schemas as S
from lattica.functions import scalar as fn
from lattica.operators.graph import propagate
from lattica.session import written


def layer_words(tokens: DataFrame, share: float = S.LAYER_WORD_SHARE) -> DataFrame:
    """token, files: words in that share of the files or more; tokens: node_id, tokens (distinct)."""
    n = tokens.agg(F.count("*").alias("n"))
    df = tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("files"))
    return df.crossJoin(F.broadcast(n)).where(F.col("files") / F.col("n") >= share).select("token", "files")


def layer_word_set(tokens: DataFrame) -> DataFrame:
    """token: the words that name layers, by their share of the files or by custom."""
    custom = tokens.sparkSession.createDataFrame([(w,) for w in sorted(set(S.LAYER_WORDS))], "token string")
    return layer_words(tokens).select("token").unionByName(custom).distinct()


def without_layer_words(tokens: DataFrame) -> DataFrame:
    """node_id, tokens without the words that name layers; tokens: node_id, tokens (distinct).

    A node that has no other words keeps an empty list."""
    held = written(tokens.select("node_id", "tokens"), "tokens")
    left = held.select("node_id", F.explode("tokens").alias("token")).join(layer_word_set(held), "token", "left_anti")
    kept = left.groupBy("node_id").agg(F.array_sort(F.collect_list("token")).alias("kept"))
    return held.select("node_id").join(kept, "node_id", "left").select("node_id", F.coalesce("kept", F.array().cast("array<string>")).alias("tokens"))


def token_classes(tokens: DataFrame) -> DataFrame:
    """token, files, kind: common words, and the recurring words that can name a domain of their own."""
    known = sorted({w for ws in S.LEXICON.values() for w in ws.split()})
    n = tokens.agg(F.count("*").alias("n"))
    df = tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("files")).crossJoin(F.broadcast(n))
    share = F.col("files") / F.col("n")
    common = df.where(share > S.NAME_MAX_SHARE).select("token", "files", F.lit("common").alias("kind"))
    fit = df.where((share <= S.NAME_MAX_SHARE) & ~F.col("token").isin(known) & (F.length("token") >= 4) & (F.col("files") >= S.EMERGENT_MIN_FILES) & (share <= S.EMERGENT_MAX_SHARE))
    top = fit.orderBy(F.desc("files"), F.desc("token")).limit(S.EMERGENT_LIMIT).select("token", "files", F.lit("emergent").alias("kind"))
    return common.unionByName(top)


def single_winner(votes: DataFrame, key: str) -> DataFrame:
    """key, domain, votes of the keys whose top domain is alone at the top; votes: key, domain, votes."""
    w = Window.partitionBy(key).orderBy(F.desc("votes"))
    top = votes.withColumn("r", F.rank().over(w)).where("r = 1").groupBy(key).agg(F.count("*").alias("n"), F.first("domain").alias("domain"), F.first("votes").alias("votes"))
    return top.where("n = 1").select(key, "domain", "votes")


def package_votes(packages: DataFrame, key: str) -> DataFrame:
    """Votes of packages for domains; packages: key, package."""
    return packages.withColumn("domain", fn.package_domain(F.col("package"))).where("domain is not null").groupBy(key, "domain").agg(F.countDistinct("package").alias("votes"))


def word_votes(tokens: DataFrame, key: str) -> DataFrame:
    """Votes of path words for domains; tokens: key, tokens."""
    lex = F.create_map(*(x for d, ws in S.LEXICON.items() for x in (F.lit(d), F.array(*(F.lit(w) for w in ws.split())))))
    hits = tokens.select(key, "tokens", F.explode(lex).alias("domain", "words")).withColumn("votes", F.size(F.array_intersect("tokens", "words")).cast("long"))
    return hits.where("votes > 0").select(key, "domain", "votes")


def seeds(nodes: DataFrame) -> DataFrame:
    """node_id, domain, score, source: both signals agree, package, name, or one recurring word.

    nodes: node_id, canonical_path, external_dependencies."""
    tokens = nodes.select("node_id", fn.tokenize(F.col("canonical_path")).alias("tokens"))
    classes = token_classes(tokens)
    word = tokens.select("node_id", F.explode("tokens").alias("token")).join(F.broadcast(classes), "token", "left")
    used = word.where("kind is null or kind <> 'common'").groupBy("node_id").agg(F.collect_set("token").alias("tokens"), F.collect_set(F.when(F.col("kind") == "emergent", F.col("token"))).alias("open"))
    dep = single_winner(package_votes(nodes.select("node_id", F.explode_outer("external_dependencies").alias("package")), "node_id"), "node_id")
    nam = single_winner(word_votes(used, "node_id"), "node_id")
    j = nodes.select("node_id").join(dep.select("node_id", F.col("domain").alias("d")), "node_id", "left").join(nam.select("node_id", F.col("domain").alias("w")), "node_id", "left").join(used.select("node_id", "open"), "node_id", "left")
    one = F.size("open") == 1
    pick = F.when(F.expr("d = w"), F.struct(F.col("d").alias("domain"), F.lit(0.95).alias("score"), F.lit("seed:dependency+name").alias("source")))
    pick = pick.when(F.col("d").isNotNull(), F.struct(F.col("d").alias("domain"), F.lit(0.90).alias("score"), F.lit("seed:dependency").alias("source")))
    pick = pick.when(F.col("w").isNotNull(), F.struct(F.col("w").alias("domain"), F.lit(0.75).alias("score"), F.lit("seed:name").alias("source")))
    pick = pick.when(one, F.struct(fn.capitalize(F.get("open", F.lit(0))).alias("domain"), F.lit(0.65).alias("score"), F.lit("seed:name-emergent").alias("source")))
    return j.withColumn("s", pick).where("s is not null").select("node_id", "s.domain", "s.score", "s.source")


def classify(scores: DataFrame, key: str = "node") -> DataFrame:
    """The top domain of each node, unless it is weak or close to the second; scores: key, domain, score."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "domain")
    top = scores.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("r = 1")
    clear = (F.col("score") >= S.NODE_MIN_SCORE) & (F.coalesce("second", F.lit(0.0)) * S.MARGIN <= F.col("score"))
    return top.where(clear).select(key, "domain", fn.half_up(F.least(F.lit(0.95), F.col("score")), 2).alias("confidence"))


def cluster_domains(members: DataFrame) -> DataFrame:
    """The domain of each cluster that holds enough of all its members; members: cluster_id, domain, confidence."""
    size = members.groupBy("cluster_id").agg(F.count("*").alias("members"))
    per = members.where("domain is not null").groupBy("cluster_id", "domain").agg(F.count("*").alias("files"), F.avg("confidence").alias("mean"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("files"), "domain")
    top = per.withColumn("r", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("files").over(w), F.lit(0))).where("r = 1").join(size, "cluster_id")
    share = F.col("files") / F.col("members")
    clear = (share >= S.CLUSTER_MIN_SHARE) & (F.col("files") >= S.MARGIN * F.col("second"))
    return top.where(clear).select("cluster_id", "domain", "files", "members", fn.half_up(F.least(F.lit(0.95), share * F.col("mean")), 2).alias("confidence"))


def emergent_names(members: DataFrame) -> DataFrame:
    """The dominant path word of each cluster; members: cluster_id, tokens."""
    size = members.groupBy("cluster_id").agg(F.count("*").alias("members"))
    per = members.select("cluster_id", F.explode("tokens").alias("token")).groupBy("cluster_id", "token").agg(F.count("*").alias("files"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("files"), "token")
    top = per.withColumn("r", F.row_number().over(w)).where("r = 1").join(size, "cluster_id")
    share = F.col("files") / F.col("members")
    return top.where((F.col("members") >= 2) & (share >= S.CLUSTER_MIN_SHARE)).select("cluster_id", fn.capitalize(F.col("token")).alias("domain"), "files", "members", fn.half_up(F.least(F.lit(0.8), share), 2).alias("confidence"))


def detect(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Domains of nodes (node_id, domain, confidence, source) and of clusters.

    nodes: node_id, canonical_path, external_dependencies, cluster_id, cluster_name; edges:
    source_id, target_id, weight, edge_type, is_dead_import. Clusters of infrastructure take no part."""
    infra = F.coalesce(F.col("cluster_id").isin(*S.INFRA_CLUSTERS) | F.col("cluster_name").isin(*S.INFRA_CLUSTERS), F.lit(False))
    active = nodes.where(~infra)
    s = seeds(active)
    ids = active.select("node_id")
    used = edges.where("edge_type <> 'RENDERS' and weight > 0").join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    weight = F.when(F.col("is_dead_import"), F.col("weight") * S.DEAD_FACTOR).otherwise(F.col("weight"))
    scores = propagate(used.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), weight.alias("weight")), s.select(F.col("node_id").alias("node"), "domain", "score"), S.ROUNDS, S.DECAY, S.TOLERANCE)
    found = classify(scores).withColumnRenamed("node", "node_id").join(s.select("node_id", "source"), "node_id", "left").withColumn("source", F.coalesce("source", F.lit("propagated")))
    members = active.select("node_id", "cluster_id", fn.tokenize(F.col("canonical_path"), 4).alias("tokens")).join(found, "node_id", "left")
    firm = cluster_domains(members).select("cluster_id", "domain", "confidence", F.lit("CANONICAL").alias("kind"))
    known = sorted({*S.LEXICON, *S.PACKAGES})
    firm = firm.withColumn("kind", F.when(F.col("domain").isin(known), "CANONICAL").otherwise("EMERGENT"))
    named = emergent_names(members).join(firm.select("cluster_id"), "cluster_id", "left_anti").select("cluster_id", "domain", "confidence", F.lit("EMERGENT").alias("kind"))
    rest = active.select("cluster_id").distinct().join(firm.unionByName(named).select("cluster_id"), "cluster_id", "left_anti").select("cluster_id", F.lit(None).cast("string").alias("domain"), F.lit(0.0).alias("confidence"), F.lit("UNCLASSIFIED").alias("kind"))
    inf = nodes.where(infra).select("cluster_id").distinct().select("cluster_id", F.lit(None).cast("string").alias("domain"), F.lit(0.0).alias("confidence"), F.lit("INFRASTRUCTURE").alias("kind"))
    return found, firm.unionByName(named).unionByName(rest).unionByName(inf)
