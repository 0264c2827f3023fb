"""What each filter removes in each order: filters applied along a trie of permutations.

Every order of the filters is a path from the root; what is left after a prefix depends on the
prefix's set alone, so the 120 orders of five filters share 32 states. The trie is walked depth
first: a state is a persisted DataFrame of the documents that survive its set, a child is the
state without those that fail one more filter, and a state that was reached by another path is not
made again. At each state the removals of every edge that leaves it are counted by part, and the
state is released when its children have been made, so that no more are held than filters. The
counts are one written row for each part and state, never held at the driver.

The filters themselves are decided once for each document, over its whole text and, for copies,
over the whole table: texts are told apart by SHA-256, the least doc_id of each digest is joined
back, and digests that hold over a thousandth of all rows (so a thousand at most) are broadcast
instead of being shuffled to one task.

Defined cases: a null text counts as empty, a null source is the part of the empty string; a null
doc_id counts as larger than any other and has no labels; rows that repeat a doc_id are documents
each, and of several labels of one doc_id any 1 counts; null labels count as 0; an empty table
gives an empty result; texts of any length are judged by built-in functions; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.joins import looked_up
from lattica.session import dropped, settled, written

FILTERS = "ABCDE"
_BLANKS = "[\\x20\\x09-\\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> list[Column]:
    """A to D: short, repetitive, in capitals, with markup signs."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, _BLANKS), "")
    n, different = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    points = F.length(text).cast("long")
    capitals = points - F.length(F.translate(text, _CAPITALS, ""))
    return [n < 200, 100 * different < 50 * n, 100 * capitals > 2 * points, text.rlike("[#$%&*|]")]


def with_earlier_copies(rows: DataFrame, digest: str, key: str, flag: str) -> DataFrame:
    """rows and a flag: another row of a smaller key has the same digest (a null key is the largest).

    rows are read three times, so they should be written."""
    copies = written(rows.groupBy(digest).agg(F.min(key).alias("__first"), F.count("*").alias("__n")).where("__n > 1"), "copies")
    found = looked_up(rows, copies, [digest], F.col("__n"), rows.count())
    later = F.when(F.col("__first").isNull(), F.lit(False)).otherwise(F.coalesce(F.col(key) > F.col("__first"), F.lit(True)))
    return found.withColumn(flag, later).drop("__first", "__n")


def with_labels(rows: DataFrame, labels: DataFrame, key: str, names: dict[str, Column]) -> DataFrame:
    """rows and a flag for each name: whether any label row of the key fulfils its condition."""
    known = labels.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.coalesce(F.max(c), F.lit(False)).alias(n) for n, c in names.items()))
    found = rows.where(F.col(key).isNotNull()).join(known, key, "left")
    unknown = rows.where(F.col(key).isNull()).select("*", *(F.lit(None).cast("boolean").alias(n) for n in names))
    return found.unionByName(unknown).withColumns({n: F.coalesce(n, F.lit(False)) for n in names})


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (a bit for each of the five filters, from A) and the flags good and toxic of every document."""

    def make() -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_failures(F.col("text")))), F.lit(0))
        judged = written(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), bits.alias("fails")), "judged")
        copied = with_earlier_copies(judged, "digest", "doc_id", "copy").drop("digest")
        marked = with_labels(copied, labels, "doc_id", {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
        return marked.select("part", (F.col("fails") + F.when(F.col("copy"), 1 << 4).otherwise(0)).alias("fails"), "good", "toxic")

    return settled(make, "failures")


def states(rows: DataFrame, filters: int, counted: list[str]) -> DataFrame:
    """A row for each part and set of applied filters: the documents left, and by filter what the edge
    that applies it next removes, altogether and of each counted flag; the root also has single failures."""
    made: list[DataFrame] = []

    def counts(df: DataFrame, state: int) -> DataFrame:
        fails = [(F.col("fails").bitwiseAND(1 << k) != 0) if not state >> k & 1 else F.lit(False) for k in range(filters)]
        lost = [F.array(*(F.count_if(f & F.col(c)) for f in fails)).alias(f"{c}_lost") for c in counted]
        alone = [F.count_if(F.col("fails") == 1 << k) if not state else F.lit(0).cast("long") for k in range(filters)]
        return df.groupBy("part").agg(F.lit(state).alias("state"), F.count("*").alias("n"), F.array(*map(F.count_if, fails)).alias("removed"), F.array(*alone).alias("alone"), *lost)

    def visit(state: int, df: DataFrame) -> None:
        df.persist()
        made.append(written(counts(df, state), "state"))
        seen.add(state)
        for k in range(filters):
            if not state >> k & 1 and state | 1 << k not in seen:
                visit(state | 1 << k, df.where(F.col("fails").bitwiseAND(1 << k) == 0))
        df.unpersist()

    def make() -> DataFrame:
        visit(0, rows)
        return rows.sparkSession.read.schema(made[0].schema).parquet(*(m._lattica_path for m in made))

    seen: set[int] = set()
    return settled(make, "states")


def orders(found: DataFrame, names: str, counted: list[str]) -> DataFrame:
    """A row for each part, order of the filters and step, from the counts of the states."""
    n = len(names)
    every = ["".join(p) for p in permutations(names)]
    weight = [F.col("removed")[k] * _orders_through(F.col("state"), n) for k in range(n)]  # nothing is removed by a filter that was applied
    values = F.struct("n", "removed", *(f"{c}_lost" for c in counted))
    root = F.col("state") == 0
    parts = found.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct("state", values))).alias("at"),
        F.max(F.when(root, F.col("removed"))).alias("fails"),
        F.max(F.when(root, F.col("alone"))).alias("alone"),
        F.array(*map(F.sum, weight)).alias("shapley"),
    )
    rows = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, every)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    k = F.instr(F.lit(names), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    before = sum((F.when(F.instr("filter_order", F.lit(c)) < F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(names)), F.lit(0))
    rows = rows.withColumns({"k": k, "before": before})
    here, after = F.col("at")[F.col("before")], F.col("at")[F.col("before") + F.element_at(F.array(*(F.lit(1 << i) for i in range(n))), F.col("k") + 1)]
    zero = F.lit(0).cast("long")
    removed = F.coalesce(here["removed"][F.col("k")], zero)
    return rows.select(
        "part", "filter_order", "step", F.coalesce(after["n"], zero).alias("kept"), removed.alias("removed"), (F.col("fails")[F.col("k")] - removed).alias("redundant"), F.col("alone")[F.col("k")].alias("unique_fails"),
        *(F.coalesce(here[f"{c}_lost"][F.col("k")], zero).alias(f"{c}_lost") for c in counted), F.col("shapley")[F.col("k")].alias("shapley"),
    )


def _orders_through(state: Column, n: int) -> Column:
    """How many orders pass from a state over one of its edges."""
    size = F.bit_count(state)
    return F.element_at(F.array(*(F.lit(factorial(s) * factorial(n - 1 - s)) for s in range(n)), F.lit(0)), size + 1).cast("long")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters in all orders, by source."""
    rows = failures(docs, labels)
    found = states(rows, len(FILTERS), ["good", "toxic"])
    dropped(rows)
    return orders(found, FILTERS, ["good", "toxic"])
