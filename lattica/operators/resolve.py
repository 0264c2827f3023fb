"""Import resolution: ordered probes against the file registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica import schemas as S
from lattica.functions import scalar as fn
from lattica.operators.infer import ancestors


def normalized(path):
    """A path without `.` and with `..` applied."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    walk = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(walk, "/")


def probe(bases: DataFrame, registry: DataFrame, key: list[str]) -> DataFrame:
    """The first candidate of each key that exists: base order first, then the suffix order.

    bases: key, base_order, base; registry: canonical_path. Candidates are exploded and equi-joined."""
    tries = F.transform(F.array(*(F.lit(x) for x in S.PROBES)), lambda e: F.concat(F.col("base"), e))
    c = bases.select(*key, "base_order", F.posexplode(tries).alias("probe", "canonical_path"))
    return c.join(registry.select("canonical_path"), "canonical_path").groupBy(*key).agg(F.min_by("canonical_path", F.struct("base_order", "probe")).alias("resolved"))


def nearest_scope(files: DataFrame, scopes: DataFrame) -> DataFrame:
    """canonical_path, scope: the longest directory above a file that is a scope; scopes: scope."""
    d = fn.parent(F.col("canonical_path"))
    up = files.select("canonical_path", F.posexplode(F.concat(F.array(d), ancestors(d))).alias("depth", "scope"))
    return up.join(scopes.select("scope").distinct(), "scope").groupBy("canonical_path").agg(F.min_by("scope", "depth").alias("scope"))


def import_bases(imports: DataFrame, aliases: DataFrame, packages: DataFrame) -> DataFrame:
    """Candidate bases of imports: relative paths, the first alias that fits, workspace packages.

    imports: source_path, spec; aliases: scope, alias, dir, ord; packages: package, dir."""
    rel = imports.where(F.col("spec").startswith(".")).select("source_path", "spec", F.lit(0).alias("base_order"), normalized(F.concat_ws("/", fn.parent(F.col("source_path")), "spec")).alias("base"))
    bare = imports.where(~F.col("spec").startswith("."))
    scoped = bare.join(nearest_scope(bare.select(F.col("source_path").alias("canonical_path")).distinct(), aliases).withColumnRenamed("canonical_path", "source_path"), "source_path")
    # an import meets an alias by equality with its own beginning, of the lengths that aliases of its scope have
    lengths = aliases.groupBy("scope").agg(F.collect_set(F.length("alias")).alias("lengths"))
    begins = F.transform(F.filter("lengths", lambda n: n <= F.length("spec")), lambda n: F.substring("spec", F.lit(1), n))
    begun = scoped.join(lengths, "scope").select("source_path", "spec", "scope", F.explode(begins).alias("alias"))
    fits = begun.join(aliases, ["scope", "alias"]).groupBy("source_path", "spec").agg(F.min_by(F.struct("alias", "dir"), "ord").alias("a"))
    tail = F.expr("substring(spec, length(a.alias) + 1)")
    by_alias = fits.select("source_path", "spec", F.lit(0).alias("base_order"), normalized(F.concat_ws("/", "a.dir", tail)).alias("base"))
    by_package = bare.withColumn("package", fn.package(F.col("spec"))).join(packages, "package")
    rest = F.expr("substring(spec, length(package) + 1)")
    two = by_package.select("source_path", "spec", F.posexplode(F.array(normalized(F.concat(F.col("dir"), F.lit("/src"), rest)), normalized(F.concat(F.col("dir"), rest)))).alias("p", "base"))
    return rel.unionByName(by_alias).unionByName(two.select("source_path", "spec", (F.col("p") + 1).alias("base_order"), "base"))


def resolve(imports: DataFrame, registry: DataFrame, aliases: DataFrame, packages: DataFrame) -> DataFrame:
    """source_path, spec, resolved for the imports that lead to a file of the registry."""
    return probe(import_bases(imports, aliases, packages), registry, ["source_path", "spec"])
