"""Titles, summaries and advisory checks of clusters, with an optional text model.

The model is any callable from prompt to text, given by the caller; None leaves the deterministic
fallbacks. Answers are parsed tolerantly and never override what the data says.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import scalar as fn
from lattica.operators.analytics import auto_titles, top_members
from lattica.session import ship, written
from lattica.sources.code import registry

BATCH = 8
PROMPTS_A_TASK = 4
ANSWER = "struct<cluster_id:string,title:string,summary:string>"
CHECK = "struct<cluster_id:string,valid:boolean,confidence:double,reason:string,suggested_name:string>"


def prompts(nodes: DataFrame, by: str = "cluster_id") -> DataFrame:
    """batch, prompt: eight clusters a prompt, each with its top members and what they are about.

    nodes: cluster_id, canonical_path, centrality_score, text_summary."""
    top = top_members(nodes).join(nodes.select(by, "canonical_path", "text_summary"), [by, "canonical_path"])
    line = F.concat(F.lit("- "), "canonical_path", F.lit(": "), F.coalesce(F.substring("text_summary", 1, 100), F.lit("")))
    per = top.withColumn("line", line).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]), "\n").alias("lines"))
    ids = registry(per.select(F.col(by).cast("string").alias("canonical_path"))).select(F.col("canonical_path").alias(by), F.floor(F.col("node_id") / BATCH).alias("chunk"))
    numbered = per.join(ids, by)
    text = F.concat(F.lit("Cluster "), by, F.lit(":\n"), "lines")
    joined = numbered.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("c"), text.alias("t")))).alias("x"))
    return joined.select(F.col("chunk").alias("batch"), F.concat(F.lit("Answer with a JSON array of objects with cluster_id, title and summary.\n\n"), F.array_join(F.transform("x", lambda s: s["t"]), "\n\n")).alias("prompt"))


def answered(asked: DataFrame, model: Callable[[str], str | None], ddl: str, tries: int = 2, pause: float = 0.0) -> DataFrame:
    """Rows of the JSON arrays that a model returns; asked: batch, prompt.

    Prompts are dealt over the session's tasks by ranges of batch, four or more to a task, so a
    provider meets as many callers as the session has cores at most. A call that fails is made again after
    a pause, `tries` times in all; then it gives no rows, and its task makes no more calls."""
    ship(asked.sparkSession)
    asked = written(asked.select("batch", "prompt"), "prompts")
    tasks = max(1, min(asked.sparkSession.sparkContext.defaultParallelism, asked.count() // PROMPTS_A_TASK))

    def said(prompt: str) -> str | None:
        for left in reversed(range(tries)):
            try:
                return model(prompt)
            except Exception:  # a provider's failure is answered by the fallback
                if not left:
                    raise
                time.sleep(pause)
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = False
        for f in frames:
            out = []
            for p in f["prompt"]:
                try:
                    out.append(None if failed else said(p))
                except Exception:
                    failed = True
                    out.append(None)
            yield pd.DataFrame({"answer": out})

    dealt = asked.repartitionByRange(tasks, "batch").sortWithinPartitions("batch") if tasks > 1 else asked.coalesce(1).sortWithinPartitions("batch")
    return dealt.select("prompt").mapInPandas(run, "answer string").select(F.explode(fn.json_array(F.col("answer"), ddl)).alias("a")).select("a.*")


def label_clusters(nodes: DataFrame, model: Callable[[str], str | None] | None = None) -> DataFrame:
    """cluster_id, title, summary of each cluster: the model's, else a title from directories and a count."""
    plain = auto_titles(nodes).join(nodes.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster_id").select("cluster_id", "title", F.concat(F.lit("Group of "), "n", F.lit(" files")).alias("summary"))
    if model is None:
        return plain
    given = answered(prompts(nodes), model, ANSWER).groupBy("cluster_id").agg(F.min("title").alias("t"), F.min("summary").alias("s"))
    return plain.join(given, "cluster_id", "left").select("cluster_id", F.coalesce("t", "title").alias("title"), F.coalesce("s", "summary").alias("summary"))


def validate_domains(clusters: DataFrame, asked: DataFrame, model: Callable[[str], str | None] | None = None) -> DataFrame:
    """clusters with advisory columns llm_valid, llm_confidence, llm_reason and llm_suggested_name.

    Only canonical and emergent domains are asked about; asked: batch, prompt."""
    none = clusters.select("*", F.lit(None).cast("boolean").alias("llm_valid"), F.lit(None).cast("double").alias("llm_confidence"), F.lit(None).cast("string").alias("llm_reason"), F.lit(None).cast("string").alias("llm_suggested_name"))
    if model is None:
        return none
    got = answered(asked, model, CHECK).groupBy("cluster_id").agg(F.min(F.struct(F.col("valid").alias("llm_valid"), F.col("confidence").alias("llm_confidence"), F.col("reason").alias("llm_reason"), F.col("suggested_name").alias("llm_suggested_name"))).alias("v"))
    fit = F.col("kind").isin("CANONICAL", "EMERGENT")
    return clusters.join(got, "cluster_id", "left").select(*clusters.columns, *(F.when(fit, F.col(f"v.{c}")).alias(c) for c in ("llm_valid", "llm_confidence", "llm_reason", "llm_suggested_name")))
