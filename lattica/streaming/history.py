"""A project's history as a running job: commits come in, snapshots and their deltas are stored once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.operators.history import snapshot_delta
from lattica.session import scope, written
from lattica.sources.versions import Versions

KEYS = ["project_id", "sha"]
COMMITS, NODES, DELTAS = "commits", "commit_nodes", "commit_deltas"

#: From commits (project_id, sha, ts) to the files of each: project_id, sha, path, cluster_id.
Analysis = Callable[[DataFrame], DataFrame]


def store_commits(commits: DataFrame, analysis: Analysis, store: Versions, transaction: tuple[str, int] | None = None, tag: str = "") -> int:
    """Analyses the commits that aren't stored yet and stores them with their deltas in one version; its number.

    commits: project_id, sha, ts. A commit that the analysis gives no files for is left out and asked
    for again when it comes again. Each is compared with the one before it by time, stored or new; all
    pairs of a batch go through one job."""
    spark = commits.sparkSession
    m = store.manifest()
    if transaction and m.transactions.get(transaction[0], -1) >= transaction[1]:
        return m.version
    known = COMMITS in m.schemas
    with scope():
        asked = commits.select(*KEYS, "ts").where("project_id is not null and sha is not null").dropDuplicates(KEYS)
        if known:
            asked = asked.join(store.read(COMMITS, version=m.version).select(*KEYS), KEYS, "left_anti")
        asked = written(asked, "commits")
        nodes = written(analysis(asked).select(*KEYS, "path", "cluster_id"), "commit-nodes")
        new = written(asked.join(nodes.select(*KEYS).distinct(), KEYS), "commits")
        headers = new.withColumn("new", F.lit(True))
        every = nodes
        if known:
            touched = new.select("project_id").distinct()
            headers = headers.unionByName(store.read(COMMITS, version=m.version).join(touched, "project_id", "left_semi").select(*KEYS, "ts", F.lit(False).alias("new")))
            every = every.unionByName(store.read(NODES, version=m.version).select(*nodes.columns))
        before = F.lag("sha").over(Window.partitionBy("project_id").orderBy("ts", "sha"))
        pairs = written(headers.withColumn("previous", before).where("new and previous is not null").select("project_id", "sha", "previous"), "pairs")
        old = pairs.join(every.withColumnRenamed("sha", "previous"), ["project_id", "previous"]).select(*KEYS, "path", "cluster_id")
        fresh = pairs.join(nodes, KEYS).select(*KEYS, "path", "cluster_id")
        delta = snapshot_delta(old, fresh, KEYS).join(pairs, KEYS)
        return store.commit({COMMITS: new, NODES: nodes.join(new.select(*KEYS), KEYS, "left_semi"), DELTAS: delta}, tag, transaction=transaction)


def follow(commits: DataFrame, analysis: Analysis, root: str, checkpoint: str, name: str = "history") -> StreamingQuery:
    """Runs `store_commits` over all of a stream of commits that is there, a batch at a time.

    A batch is a transaction of the store, so one that was stored before the job stopped writes nothing
    when it is run again. Batches are in the order in which commits arrive; inside one the oldest comes first."""

    def each(batch: DataFrame, number: int) -> None:
        store_commits(batch, analysis, Versions(batch.sparkSession, root), (name, number), f"{name}-{number}")

    return commits.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
