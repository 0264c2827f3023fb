"""Joins that withstand hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY = 1000  # a key is heavy if more than one in so many rows have it
PAIRS = 1 << 20  # pairs that one task makes of a key
TASKS = 4096  # of a join at most


def looked_up(rows: DataFrame, known: DataFrame, keys: list[str], weight: Column, total: int) -> DataFrame:
    """rows with the columns of known (one row a key), null where it has no such key.

    weight is a column of known: how many rows have its key, and total the number of all rows. So
    at most a thousand keys are heavy, and these are broadcast; a shuffle meets light keys only.
    rows and known are read twice, so they should be written; names in known must be new."""
    share, mark = weight * HEAVY > total, "__heavy"
    tried = rows.join(F.broadcast(known.where(share).withColumn(mark, F.lit(1))), keys, "left")
    heavy = tried.where(F.col(mark).isNotNull()).drop(mark)
    other = tried.where(F.col(mark).isNull()).select(*rows.columns).join(known.where(~share), keys, "left")
    return heavy.unionByName(other)


def paired(left: DataFrame, right: DataFrame, key: str, most: int = PAIRS, weights: tuple[Column, Column] | None = None) -> DataFrame:
    """The inner join of two sides by a key, a key of many pairs split over many tasks.

    A key with l and r rows is dealt into about l * r / most cells: its left rows by their hash, the
    right ones to each cell. The pairs are counted first, and the join has as many tasks as they need:
    its sides are small beside them, so their bytes tell nothing. weights: what a left and a right row
    count for where they stand for several rows. Other columns must have different names on the two sides."""
    many = [F.count("*") if weights is None else F.sum(w.cast("long")) for w in weights or (None, None)]
    sizes = left.groupBy(key).agg(many[0].alias("__l"), F.count("*").alias("__n")).join(right.groupBy(key).agg(many[1].alias("__r")), key)
    hot = sizes.where(F.col("__l") * F.col("__r") > most).select(key, F.least(F.ceil(F.col("__l") * F.col("__r") / most), F.col("__n")).alias("__cells"))
    # a key is hot only if it has more than most ** 0.5 rows on a side, so hot keys are few beside the rows
    one = F.coalesce("__cells", F.lit(1).cast("long"))
    a = left.join(hot, key, "left").withColumn("__cell", F.pmod(F.xxhash64(*(c for c in left.columns if c != key)), one)).drop("__cells")
    b = right.join(hot, key, "left").withColumn("__cell", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("__cells")
    pairs = sizes.agg(F.sum(F.col("__l") * F.col("__r"))).first()[0] or 0
    tasks = min(TASKS, max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // most)))
    return a.repartition(tasks, key, "__cell").join(b.repartition(tasks, key, "__cell"), [key, "__cell"]).drop("__cell")
