"""Keyed state with timers and history as a job, against their batch forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lattica import schemas as S
from lattica.operators import history
from lattica.sources.versions import Versions
from lattica.streaming import history as stream_history
from lattica.streaming import progress, state

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def streamed(spark, rows, path, make, name, files=2):
    """All rows of a DataFrame as a stream of files, and at last two rows that move the watermark."""
    end = rows.agg(F.max("ts")).first()[0]
    rows.repartition(files).write.parquet(f"{path}/in")
    for days in (900, 1800):
        last = rows.limit(1).withColumn("ts", F.lit(end + dt.timedelta(days=days)).cast("timestamp")).withColumn(rows.columns[0], F.lit("the end"))
        last.write.mode("append").parquet(f"{path}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = make(source).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    assert q.awaitTermination(300) and q.exception() is None
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    return sorted(tuple(r) for r in spark.table(name).collect() if r[0] != "the end"), left


def test_poll_rules(spark):
    ok, bad = ("running", "s"), (None, None)
    polls = lambda xs, step=1: [(1_000_000 * step * i, i, *x) for i, x in enumerate(xs)]
    out = lambda xs, **k: [(x[1], x[2], x[3]) for x in state.advanced(state.Run(), "t", polls(xs, **k), state.PATIENCE)]
    assert out([ok, ("Completed", "z"), ok, ("failed", "z")]) == [(1, "completed", 2), (3, "failed", 2)]
    assert out([bad] * 4 + [ok] + [bad] * 5) == [(9, "lost", 10)]
    assert out([ok] * (S.POLLS + 5)) == [(S.POLLS - 1, "timed out", S.POLLS)]
    assert out([bad] * 3 + [bad] * 3, step=state.PATIENCE) == []  # forgotten in between


def test_outcomes_of_a_stream_equal_the_batch(rocks, tmp_path):
    rows = rocks.sql("select concat('t', id % 3) as task, timestamp_seconds(1704067200 + id * 60 + 5 * (id % 7)) as ts, id as seq, case when id % 11 in (3, 4, 5, 6, 7, 8) and id > 200 then null when id % 17 = 0 then 'completed' when id % 41 = 0 then 'FAILED' else 'running' end as status, concat('s', id % 5) as stage from range(400)")
    got, left = streamed(rocks, rows, tmp_path, lambda s: state.poll_outcomes_stream(s, "300 days", 10**7), "outcomes")
    want = sorted(map(tuple, state.poll_outcomes(rows, 10**7).collect()))
    assert got == want and len(want) > 20 and {x[2] for x in want} >= {"completed", "failed"}
    asked = rocks.createDataFrame([("t0",), ("t1",), ("nobody",)], "task string")
    stages = {r["task"]: r["stage"] for r in state.progress(rows, asked).collect()}
    assert stages["nobody"] == "idle" and stages["t0"].startswith("s")
    assert state.progress(rows.withColumn("status", F.when(F.col("status").isNotNull(), "completed")), asked).where("stage <> 'idle'").isEmpty()
    assert left <= 3  # of the rows that moved the watermark


def test_uploads_of_a_stream_equal_the_batch(rocks, tmp_path):
    rows = rocks.sql("select concat('u', id div 5) as upload_id, timestamp_seconds(1704067200 + id) as ts, cast(id % 5 as int) as index, 5 as total, concat('d', id, ';') as data from range(60) where id <> 33")
    again = rows.where("index = 2").withColumn("ts", F.col("ts") - F.expr("interval 1 second")).withColumn("data", F.lit("older"))
    got, left = streamed(rocks, rows.unionByName(again.where("upload_id = 'u6'")), tmp_path, lambda s: state.assembled_stream(s, "10 minutes", dt.timedelta(hours=1)), "uploads")
    want = sorted((r["upload_id"], r["chunks"], r["content"]) for r in progress.assembled(rows).collect())
    assert got == want and len(want) == 11  # u6 lacks a chunk and is forgotten
    assert left <= 3


def test_late_rows_are_dropped(rocks, tmp_path):
    for i, ts in enumerate([T0, T0 + dt.timedelta(hours=9), T0 + dt.timedelta(minutes=5), T0 + dt.timedelta(hours=30)]):
        rocks.createDataFrame([("s", ts)], "stage string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = lambda i: rocks.readStream.schema("stage string, ts timestamp").parquet(f"{tmp_path}/in/[0-{i}]")
    for i in range(4):
        q = progress.windowed(source(i)).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = {r["window"]["start"]: r["n"] for r in rocks.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {T0: 1, T0 + dt.timedelta(hours=9): 1}  # the third row was nine hours late


def commits_of(spark, n, start=0):
    return spark.createDataFrame([(f"p{i % 2}", f"c{i:03d}", T0 + dt.timedelta(hours=i)) for i in range(start, n)], "project_id string, sha string, ts timestamp")


def files_of(commits):
    n = F.substring("sha", 2, 3).cast("int")
    rows = commits.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).where((F.col("k") + n) % 4 != 0).where(n != 7)  # c007 fails
    return rows.select("project_id", "sha", F.concat(F.lit("f"), "k").alias("path"), F.concat(F.lit("c"), F.floor((F.col("k") + n) / 3).cast("int") % 3).alias("cluster_id"))


def test_a_stopped_history_goes_on_where_it_was(spark, tmp_path):
    for i in range(6):  # six batches; the second holds a commit of the first again
        commits_of(spark, 3 * i + 3, 3 * i - (i == 1)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = lambda: spark.readStream.schema(commits_of(spark, 1).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    asked = []

    def broken(commits):
        asked.append(sorted(r["sha"] for r in commits.collect()))
        if len(asked) == 4:
            raise RuntimeError("stopped")
        return files_of(commits)

    root, check = f"{tmp_path}/store", f"{tmp_path}/check"
    with pytest.raises(Exception, match="stopped"):
        stream_history.follow(source(), broken, root, check).awaitTermination(300)
    store = Versions(spark, root)
    assert store.current() == 3
    assert stream_history.follow(source(), files_of, root, check).awaitTermination(300)
    assert all(c not in sum(asked[:i], []) for i, x in enumerate(asked) for c in x)  # no commit was analysed twice before the stop
    got = sorted(map(tuple, store.read(stream_history.DELTAS).select("project_id", "sha", "previous", "path", "change", "from_cluster", "to_cluster").collect()), key=str)
    every = commits_of(spark, 18).where("sha <> 'c007'")
    nodes = files_of(every)
    pairs = history.consecutive(every, "project_id", ["ts"], "sha").where("previous is not null")
    old = pairs.join(nodes.withColumnRenamed("sha", "previous"), ["project_id", "previous"]).select("project_id", "sha", "path", "cluster_id")
    new = pairs.join(nodes, ["project_id", "sha"]).select("project_id", "sha", "path", "cluster_id")
    want = history.snapshot_delta(old, new, ["project_id", "sha"]).join(pairs.select("project_id", "sha", "previous"), ["project_id", "sha"])
    assert got == sorted(map(tuple, want.select("project_id", "sha", "previous", "path", "change", "from_cluster", "to_cluster").collect()), key=str)
    at = store.current()
    stream_history.store_commits(commits_of(spark, 3), files_of, store, ("history", 0))  # a batch that is known
    assert store.current() == at
