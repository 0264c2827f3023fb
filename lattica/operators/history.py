"""Snapshots over time: deltas, ownership, retention, revisions and versioned upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import scalar as fn


def snapshot_delta(prev: DataFrame, new: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Changed files of snapshot pairs: path, change (added, removed, moved), from_cluster, to_cluster.

    Both sides: path, cluster_id (and the columns of `by`, e.g. a pair's id, to compare all pairs of
    a history in one job). A full outer join on the path."""
    by = by or []
    j = prev.select(*by, "path", F.col("cluster_id").alias("from_cluster"), F.lit(1).alias("p")).join(new.select(*by, "path", F.col("cluster_id").alias("to_cluster"), F.lit(1).alias("n")), [*by, "path"], "full_outer")
    change = F.when(F.col("p").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("from_cluster").eqNullSafe(F.col("to_cluster")), "moved")
    return j.withColumn("change", change).where("change is not null").select(*by, "path", "change", "from_cluster", "to_cluster")


def delta_document(delta: DataFrame, prev: DataFrame, new: DataFrame) -> DataFrame:
    """One row with the six sorted lists of a delta."""
    clusters = prev.select("cluster_id", F.lit(1).alias("p")).distinct().join(new.select("cluster_id", F.lit(1).alias("n")).distinct(), "cluster_id", "full_outer")
    c = clusters.agg(F.array_sort(F.collect_list(F.when(F.col("p").isNull(), F.col("cluster_id")))).alias("added_clusters"), F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.col("cluster_id")))).alias("removed_clusters"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("change") == kind, F.col("path"))))
    d = delta.agg(of("added").alias("added_nodes"), of("removed").alias("removed_nodes"), of("moved").alias("modified_nodes"), F.array_sort(F.collect_list(F.when(F.col("change") == "moved", F.struct(F.col("path").alias("file"), "from_cluster", "to_cluster")))).alias("moved_nodes"))
    return c.crossJoin(d)


def ownership(lines: DataFrame, keys: tuple[str, ...] = ("author",)) -> DataFrame:
    """path, keys, lines, percentage, is_primary; lines: path and the columns that name an author
    (e.g. author and email), a row for each line; unattributed ones have a null in the first."""
    per = lines.where(F.col(keys[0]).isNotNull()).groupBy("path", *keys).agg(F.count("*").alias("lines"))
    w = Window.partitionBy("path")
    share = F.col("lines") * 100.0 / F.sum("lines").over(w)
    first = F.row_number().over(w.orderBy(F.desc("lines"), *keys)) == 1
    return per.select("path", *keys, "lines", fn.half_up(share, 1).alias("percentage"), first.alias("is_primary"))


def ownership_totals(lines: DataFrame, keys: tuple[str, ...] = ("author",)) -> DataFrame:
    """keys, lines, files, percentage over all paths."""
    known = lines.where(F.col(keys[0]).isNotNull())
    per = known.groupBy(*keys).agg(F.count("*").alias("lines"), F.countDistinct("path").alias("files"))
    return per.crossJoin(F.broadcast(known.agg(F.count("*").alias("all")))).select(*keys, "lines", "files", fn.half_up(F.col("lines") * 100.0 / F.col("all"), 1).alias("percentage"))


def revision_created(revisions: DataFrame, asked: DataFrame) -> DataFrame:
    """The new rows of revisions: numbered from the largest, with the edits of the one that they copy.

    revisions: project_id, snapshot_id, number, removed, added; asked: project_id, snapshot_id,
    copy_from (null: none). A copy of a revision that the snapshot lacks is no row."""
    keys = ["project_id", "snapshot_id"]
    numbered = asked.join(next_numbers(revisions, keys, "number"), keys, "left").withColumn("number", F.coalesce("next_number", F.lit(1)))
    source = revisions.select(*keys, F.col("number").alias("copy_from"), "removed", "added", F.lit(True).alias("known"))
    found = numbered.join(source, [*keys, "copy_from"], "left").where("copy_from is null or known")
    none = lambda c: F.coalesce(c, F.array().cast(revisions.schema[c].dataType))
    return found.select(*keys, "number", none("removed").alias("removed"), none("added").alias("added"))


def revision_changed(revisions: DataFrame, changes: DataFrame) -> DataFrame:
    """revisions with the lists that changes name; changes: keys, removed, added, deleted."""
    keys = ["project_id", "snapshot_id", "number"]
    j = revisions.join(changes.select(*keys, F.col("removed").alias("r"), F.col("added").alias("a"), "deleted"), keys, "left").where("not coalesce(deleted, false)")
    return j.select(*keys, F.coalesce("r", "removed").alias("removed"), F.coalesce("a", "added").alias("added"))


def in_order(rows: DataFrame, key: str, order: list[str], newest_first: bool = False) -> DataFrame:
    """rows with place, their number under their key: how notes and revisions are listed."""
    by = [F.desc(c) if newest_first else F.asc(c) for c in order]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*by)))


def overrides_of(overrides: DataFrame, snapshot_id: str) -> DataFrame:
    """The overrides of one snapshot, by path."""
    return overrides.where(F.col("snapshot_id") == snapshot_id).orderBy("path")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), F.struct(*order)).alias("r")).select(key, "r.*")


def beyond_newest(rows: DataFrame, key: str, order: list[str], keep: int) -> DataFrame:
    """Rows older than the newest `keep` of their key: candidates for removal."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("age", F.row_number().over(w)).where(F.col("age") > keep)


def consecutive(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Each row's predecessor under its key."""
    return rows.withColumn("previous", F.lag(value).over(Window.partitionBy(key).orderBy(*order)))


def next_numbers(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    return rows.groupBy(*keys).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))


def overlay(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Effective membership: the override's cluster where there is one; both: path, cluster_id."""
    return base.join(overrides.select("path", F.col("cluster_id").alias("o")), "path", "left").withColumn("cluster_id", F.coalesce("o", "cluster_id")).drop("o")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Optimistic upsert: key, value, version, status (INSERTED, UPDATED, CONFLICT, UNCHANGED).

    base: key, value, version; changes: key, value, expected (null: expects no row). A change that
    expects another version than the stored one, or a row where there is none, is a conflict."""
    j = base.select(key, F.col("value").alias("old"), "version", F.lit(True).alias("stored")).join(changes.select(key, F.col("value").alias("new"), "expected", F.lit(True).alias("asked")), key, "full_outer")
    status = F.when(F.col("asked").isNull(), "UNCHANGED").when(F.col("stored").isNull() & F.col("expected").isNull(), "INSERTED").when(F.col("stored").isNull() | F.col("expected").isNotNull() & (F.col("expected") != F.col("version")), "CONFLICT").otherwise("UPDATED")
    s = j.withColumn("status", status)
    taken = F.col("status").isin("INSERTED", "UPDATED")
    version = F.when(F.col("status") == "INSERTED", F.lit(0).cast("long")).when(F.col("status") == "UPDATED", F.col("version") + 1).otherwise(F.col("version"))
    return s.select(key, F.when(taken, F.col("new")).otherwise(F.col("old")).alias("value"), version.alias("version"), "status")


def without(rows: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """Bulk delete: rows whose keys are not listed."""
    return rows.join(doomed.select(*keys).distinct(), keys, "left_anti")


def edited_edges(base: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """A revision's graph: base edges without the removed ids, and the added ones."""
    return base.join(removed.select("edge_id").distinct(), "edge_id", "left_anti").unionByName(added, allowMissingColumns=True)


def edit_violations(added: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge_id, problem: self loops, unknown ends, ids used twice."""
    ids = nodes.select("node_id")
    loops = added.where("source_id = target_id").select("edge_id", F.lit("self loop").alias("problem"))
    ends = added.select("edge_id", F.explode(F.array("source_id", "target_id")).alias("node_id")).join(ids, "node_id", "left_anti").select("edge_id", F.lit("unknown node").alias("problem")).distinct()
    twice = added.groupBy("edge_id").agg(F.count("*").alias("n")).where("n > 1").select("edge_id", F.lit("duplicate id").alias("problem"))
    return loops.unionByName(ends).unionByName(twice)


def commit_files(diffs: DataFrame) -> DataFrame:
    """sha with sorted lists of added, modified and deleted paths; diffs: sha, kind, path."""
    of = lambda *k: F.array_sort(F.collect_list(F.when(F.col("kind").isin(*k), F.col("path"))))
    return diffs.groupBy("sha").agg(of("ADD").alias("added"), of("MODIFY", "RENAME", "COPY").alias("modified"), of("DELETE").alias("deleted"), F.count("*").alias("total"))


def not_analyzed(commits: DataFrame, snapshots: DataFrame) -> DataFrame:
    return commits.join(snapshots.select("project_id", "sha"), ["project_id", "sha"], "left_anti")
