"""Surrogate views: the test tables seen as graphs, files, snapshots and tenants; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def edges_raw(t: Tables) -> DataFrame:
    """Line items as a multi-edge from part to supplier."""
    kind = F.when(F.col("l_returnflag") == "R", "RENDERS").when(F.col("l_returnflag") == "A", "CALLS_API").otherwise("BELONGS_TO_DOMAIN")
    return t.lineitem.select(
        F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"), F.col("l_quantity").alias("weight"), kind.alias("edge_type"),
        F.concat(F.lit("b"), "l_linenumber").alias("binding"), F.array("l_returnflag", "l_linestatus").alias("called_names"), (F.col("l_linestatus") == "F").alias("is_dead_import"), (F.col("l_linenumber") > 3).alias("is_synthetic"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("source_line"), F.lit(None).cast("int").alias("target_line"), *ORDER)


def nodes(t: Tables) -> DataFrame:
    parts = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.concat(F.lit("N"), F.col("p_partkey") % 25).alias("cluster_id"))
    return parts.unionByName(t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.concat(F.lit("N"), "s_nationkey").alias("cluster_id")))


def paths(t: Tables) -> DataFrame:
    p = F.concat_ws("/", F.lit("src"), F.lower("p_type"), F.regexp_replace("p_name", " ", "-"), "p_brand", F.concat(F.col("p_partkey").cast("string"), F.lit(".ts")))
    return t.part.select(F.col("p_partkey").alias("node_id"), p.alias("canonical_path"), "p_size", "p_type", "p_name", "p_retailprice")


def digraph(t: Tables) -> DataFrame:
    """Distinct links from users to the numbers in their events."""
    return t.events.select(F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst")).where("dst is not null").distinct()


def snapshot(t: Tables, year: int) -> DataFrame:
    """Each customer's cluster in a year: the priority of the year's last order."""
    o = t.orders.where(F.year("o_orderdate") == year)
    return o.groupBy(F.col("o_custkey").alias("path")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("cluster_id"))


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


CTE = {
    "edges_raw": """SELECT 'p' || l_partkey AS source_id, 's' || l_suppkey AS target_id, l_quantity AS weight,
        CASE l_returnflag WHEN 'R' THEN 'RENDERS' WHEN 'A' THEN 'CALLS_API' ELSE 'BELONGS_TO_DOMAIN' END AS edge_type, 'b' || l_linenumber AS binding,
        [l_returnflag, l_linestatus] AS called_names, l_linestatus = 'F' AS is_dead_import, l_linenumber > 3 AS is_synthetic,
        CASE WHEN l_linenumber > 1 THEN l_linenumber END AS source_line, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o FROM lineitem""",
    "nodes": "SELECT 'p' || p_partkey AS node_id, 'N' || (p_partkey % 25) AS cluster_id FROM part UNION ALL SELECT 's' || s_suppkey, 'N' || s_nationkey FROM supplier",
    "paths": "SELECT p_partkey AS node_id, 'src/' || lower(p_type) || '/' || replace(p_name, ' ', '-') || '/' || p_brand || '/' || p_partkey || '.ts' AS canonical_path, p_size, p_type, p_name, p_retailprice FROM part",
    "digraph": "SELECT DISTINCT user_id AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    "prev": "SELECT o_custkey AS path, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS cluster_id FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1",
    "next": "SELECT o_custkey AS path, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS cluster_id FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1",
    "vec": "SELECT vec_id AS id, label AS grp, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings",
    "merged": """SELECT source_id, target_id,
        CASE WHEN arg_min(edge_type, o) = 'BELONGS_TO_DOMAIN' AND bool_or(edge_type = 'RENDERS') THEN 'RENDERS' ELSE arg_min(edge_type, o) END AS edge_type,
        sum(weight) AS total, array_to_string(list_sort(list_distinct(flatten(list(called_names)))), ',') AS called_names, arg_max(binding, o) AS binding, bool_and(is_dead_import) AS is_dead_import,
        bool_and(is_synthetic) AS is_synthetic, arg_min(source_line, o) FILTER (source_line IS NOT NULL) AS source_line FROM edges_raw GROUP BY 1, 2""",
}


def with_views(names: str, body: str) -> str:
    """SQL with the named views in front."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTE[n]})" for n in names.split()) + "\n" + body if names else body
