"""Writing results: blueprint documents and versioned snapshot tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import schemas as S
from lattica.session import written
from lattica.sources.versions import Versions

SCHEMA_VERSION = "2.2"


def blueprint(nodes: DataFrame, edges: DataFrame, clusters: DataFrame, entries: DataFrame) -> DataFrame:
    """One row `document`: the flat relational JSON of an analysis.

    A document is one value by definition; `write_blueprint` writes one of any size."""
    plain = lambda df: df.select(*(F.map_entries(c).alias(c) if k.startswith("map") else F.col(c) for c, k in df.dtypes))  # noqa: E731  (maps have no order)
    rows = lambda df, order: plain(df).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in order)))).alias("x"))
    n, e = rows(nodes, ["canonical_path"]).withColumnRenamed("x", "nodes"), rows(edges, ["source", "target"]).withColumnRenamed("x", "edges")
    c, p = rows(clusters, ["cluster_id"]).withColumnRenamed("x", "clusters"), rows(entries, ["file"]).withColumnRenamed("x", "entry_points")
    meta = F.struct(F.size("nodes").alias("total_nodes_indexed"), F.size("edges").alias("total_edges"), F.size("clusters").alias("total_clusters"), F.coalesce("largest", F.lit(0).cast("long")).alias("max_cluster_size"), F.array_sort(F.array_distinct(F.filter(F.col("nodes.domain"), lambda d: d.isNotNull()))).alias("domains"))
    largest = nodes.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("size")).agg(F.max("size").alias("largest"))
    return n.crossJoin(e).crossJoin(c).crossJoin(p).crossJoin(largest).select(F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), meta.alias("metadata"), "nodes", "edges", "clusters", "entry_points")).alias("document"))


def read_blueprint(spark, path: str) -> DataFrame:
    return spark.read.schema(S.BLUEPRINT).option("multiLine", "true").json(path)


def _fragments(df: DataFrame, order: list[str], path: str) -> None:
    """The rows as JSON in order, each with a comma behind it, a file for each range of the order.

    A row is an object, or a plain value if its only column is `value`."""
    plain = df.select(*(F.map_entries(c).alias(c) if k.startswith("map") else F.col(c) for c, k in df.dtypes))
    ranged = plain.repartitionByRange(*order).sortWithinPartitions(*order)
    value = F.to_json(F.struct(*order, *(c for c in df.columns if c not in order)))
    if df.columns == ["value"]:
        value = F.regexp_replace(F.to_json(F.array("value")), r"^\[|\]$", "")
    ranged.select(value.alias("value")).write.mode("overwrite").option("lineSep", ",\n").text(path)


def write_document(head: dict, lists: dict[str, tuple[DataFrame, list[str]]], spark: SparkSession, path: str) -> None:
    """Writes one JSON object of head and lists under one name, without a row that holds it.

    Each list (rows and their order) is written as fragments by ranges of the order, which are copied
    one after the other: a document takes a buffer of memory, not its size. It replaces what stands
    at path when it is complete."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    work = f"{path}.parts-{uuid.uuid4().hex}"
    try:
        for name, (df, order) in lists.items():
            _fragments(df, order, f"{work}/{name}")
        out = fs.create(at(f"{work}/document"), False)
        try:
            out.write(bytearray(json.dumps(head, ensure_ascii=False)[:-1].encode()))
            separator = ", " if head else ""
            for name in lists:
                out.write(bytearray(f"{separator}{json.dumps(name)}: [".encode()))
                separator = ", "
                parts = sorted((x.getPath().getName(), x.getLen()) for x in fs.listStatus(at(f"{work}/{name}")) if x.getPath().getName().startswith("part-") and x.getLen())
                for i, (part, size) in enumerate(parts):
                    source = fs.open(at(f"{work}/{name}/{part}"))
                    jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size - 2 * (i == len(parts) - 1))  # the last comma stays out
                    source.close()
                out.write(bytearray(b"]"))
            out.write(bytearray(b"}"))
        finally:
            out.close()
        fs.delete(at(path), False)
        if not fs.rename(at(f"{work}/document"), at(path)):
            raise OSError(f"{path} couldn't be put in place")
    finally:
        fs.delete(at(work), True)


def metadata(nodes: DataFrame, edges: DataFrame, clusters: DataFrame) -> dict:
    """The counts at a document's head and the names of its domains (a short list by nature)."""
    sizes = nodes.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("size")).agg(F.max("size")).first()[0]
    domains = [r[0] for r in nodes.select("domain").where("domain is not null").distinct().orderBy("domain").toLocalIterator()]
    return {"total_nodes_indexed": nodes.count(), "total_edges": edges.count(), "total_clusters": clusters.count(), "max_cluster_size": sizes or 0, "domains": domains}


def write_blueprint(nodes: DataFrame, edges: DataFrame, clusters: DataFrame, entries: DataFrame, path: str) -> None:
    """Writes the document of `blueprint`, of any size, under one name."""
    lists = {"nodes": (nodes, ["canonical_path"]), "edges": (edges, ["source", "target"]), "clusters": (clusters, ["cluster_id"]), "entry_points": (entries, ["file"])}
    write_document({"schema_version": SCHEMA_VERSION, "metadata": metadata(nodes, edges, clusters)}, lists, nodes.sparkSession, path)


def write_cluster_report(report: DataFrame, path: str) -> None:
    """Writes `analytics.cluster_report` as one JSON document."""
    write_document({"schema_version": SCHEMA_VERSION}, {"clusters": (report, ["cluster_id"])}, report.sparkSession, path)


def write_delta_document(delta: DataFrame, prev: DataFrame, new: DataFrame, path: str) -> None:
    """Writes the six lists of `history.delta_document`, of any size, as one JSON document.

    delta: rows of `history.snapshot_delta`; prev and new: path, cluster_id of the two snapshots."""
    of = lambda kind: delta.where(F.col("change") == kind).select(F.col("path").alias("value"))
    names = [d.select(F.col("cluster_id").alias("value")).where("value is not null").distinct() for d in (prev, new)]
    moved = delta.where("change = 'moved'").select(F.col("path").alias("file"), "from_cluster", "to_cluster")
    lists = {
        "added_nodes": (of("added"), ["value"]), "removed_nodes": (of("removed"), ["value"]), "modified_nodes": (of("moved"), ["value"]), "moved_nodes": (moved, ["file"]),
        "added_clusters": (names[1].join(names[0], "value", "left_anti"), ["value"]), "removed_clusters": (names[0].join(names[1], "value", "left_anti"), ["value"]),
    }
    write_document({}, lists, delta.sparkSession, path)


def node_ids(nodes: DataFrame) -> DataFrame:
    """node_id, canonical_path: the ids under which a snapshot's files are stored."""
    from lattica.sources.code import registry

    return registry(nodes.select("canonical_path"))


def _by_id(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between known files, their ends by generated id (source_id, target_id)."""
    named = edges.join(ids.toDF("source_id", "source"), "source").join(ids.toDF("target_id", "target"), "target")
    return named.select("source_id", "target_id", *(c for c in edges.columns if c not in ("source", "target", "source_id", "target_id")))


def persist_snapshot(nodes: DataFrame, edges: DataFrame, snapshot_id: str, root: str, project_id: str | None = None, commit_sha: str | None = None, created_at: str | None = None, delta: DataFrame | None = None, transaction: tuple[str, int] | None = None) -> DataFrame:
    """Stores a snapshot in one version: nodes, edges by generated id, header and delta; its header row.

    All of it is there or none (`lattica.sources.versions`), and a snapshot stored again replaces
    itself. delta: rows of `history.snapshot_delta` with the previous snapshot's id in previous_id."""
    spark = nodes.sparkSession
    mark: Column = F.lit(snapshot_id).alias("snapshot_id")
    ids = written(node_ids(nodes), "ids")
    stored = written(nodes.drop("node_id").join(ids, "canonical_path").select(mark, "node_id", *(c for c in nodes.columns if c != "node_id")), "nodes")
    known = written(_by_id(edges, ids).select(mark, "*"), "edges")
    counts = stored.agg(F.count("*").alias("nodes_count"), F.countDistinct("cluster_id").alias("clusters_count")).first()
    kind = "snapshot_id string, project_id string, commit_sha string, created_at timestamp, nodes_count long, edges_count long, clusters_count long"
    row = (snapshot_id, project_id, commit_sha, created_at, counts["nodes_count"], known.count(), counts["clusters_count"])
    head = spark.createDataFrame([row], kind.replace("timestamp", "string")).withColumn("created_at", F.to_timestamp("created_at"))
    tables = {"nodes": stored, "edges": known, "snapshots": head}
    if delta is not None:
        tables["deltas"] = delta.select(mark, *delta.columns)
    Versions(spark, root).commit(tables, snapshot_id, transaction=transaction)
    return head


def snapshot(spark: SparkSession, root: str, snapshot_id: str) -> tuple[DataFrame, DataFrame]:
    """A snapshot's nodes and edges; only its own folders are opened."""
    store = Versions(spark, root)
    at = store.current()
    return store.read("nodes", snapshot_id, at), store.read("edges", snapshot_id, at)


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """The headers of all stored snapshots."""
    return Versions(spark, root).read("snapshots")


def current_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """project_id, snapshot_id of every project's current graph: its last header."""
    return snapshots(spark, root).groupBy("project_id").agg(F.max_by("snapshot_id", F.struct("created_at", "snapshot_id")).alias("snapshot_id"))


def persist_delta(delta: DataFrame, previous_id: str, snapshot_id: str, root: str) -> None:
    """Stores the delta that leads to a snapshot; stored again, it replaces itself."""
    rows = delta.select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(previous_id).alias("previous_id"), *delta.columns)
    Versions(delta.sparkSession, root).commit({"deltas": rows}, snapshot_id)


def persist_rows(rows: DataFrame, table: str, snapshot_id: str, root: str, expected: int | None = None) -> int:
    """Stores a snapshot's rows of a table (notes, overrides, revisions) in place of those it had; the new version."""
    marked = rows.select(F.lit(snapshot_id).alias("snapshot_id"), *(c for c in rows.columns if c != "snapshot_id"))
    return Versions(rows.sparkSession, root).commit({table: marked}, snapshot_id, expected=expected)


def stored_rows(spark: SparkSession, root: str, table: str, snapshot_id: str) -> DataFrame:
    """A snapshot's rows of a table; only its own folders are opened."""
    return Versions(spark, root).read(table, snapshot_id)


def rewrite_clusters(root: str, snapshot_id: str, clusters: DataFrame, expected: int | None = None) -> int:
    """Puts a snapshot's checked clusters in place of the stored ones; the new version.

    With expected, the version that they were read from, a rewrite on something older is a `Conflict`."""
    return persist_rows(clusters, "clusters", snapshot_id, root, expected)
