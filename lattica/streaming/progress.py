"""Progress of long tasks: batch forms and streams of the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame) -> DataFrame:
    """task, stage, ts: the last state of each task; works on a batch, and on a stream in update mode.

    events: task, stage, ts, seq."""
    return events.groupBy("task").agg(F.max_by("stage", F.struct("ts", "seq")).alias("stage"), F.max("ts").alias("ts"))


def latest_stream(events: DataFrame, path: str, checkpoint: str):
    """Runs `latest` over a stream of what has arrived, into a table in memory named `path`."""
    return latest(events).writeStream.outputMode("complete").format("memory").queryName(path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events for each stage and time window, late ones dropped after the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "stage").agg(F.count("*").alias("n"))


def error_runs(polls: DataFrame, most: int = 5) -> DataFrame:
    """task, longest_run, gave_up: the longest run of failed polls; polls: task, bad, ts, seq."""
    w = Window.partitionBy("task").orderBy("ts", "seq")
    runs = polls.withColumn("g", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(w)).groupBy("task", "g").agg(F.count_if(F.col("bad")).alias("n"))
    return runs.groupBy("task").agg(F.max("n").alias("longest_run"), (F.max("n") >= most).alias("gave_up"))


def assembled(chunks: DataFrame) -> DataFrame:
    """upload_id, content, chunks of uploads whose chunks are all there; chunks: upload_id, index, data, total."""
    per = chunks.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("index", "data"))).alias("c"), F.count("*").alias("chunks"), F.countDistinct("index").alias("d"), F.max("total").alias("total"))
    return per.where("chunks = total and d = chunks").select("upload_id", F.array_join(F.transform("c", lambda x: x["data"]), "").alias("content"), "chunks")


def poll_schedule(polls: DataFrame, most: int = 900) -> DataFrame:
    """task, polls, timed_out: tasks that were asked for too often without an end; polls: task, terminal."""
    return polls.groupBy("task").agg(F.count("*").alias("polls"), ((F.count("*") >= most) & ~F.bool_or("terminal")).alias("timed_out"))


def first_task(tasks: DataFrame) -> DataFrame:
    """project_id, task: the first task that was started for each project; tasks: task, project_id, seq."""
    return tasks.groupBy("project_id").agg(F.min_by("task", F.struct("seq", "task")).alias("task"))
