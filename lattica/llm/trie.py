"""The prefix trie of all conversations, merged family first.

Conversations of one base id are a family: each starts with the first turns of the base. Their
turns, as digests, are brought together by base id (the base's own turns in one group, the others'
in the cogroup beside it), the conversations are rebuilt, and the family's small trie is made in
one pass. Only the nodes of these tries are shuffled on: equal prefixes of different families meet
by a chained digest of their turns and are added up, with partial sums before the shuffle.

Sums over subtrees take one more pass over the families instead of one for each depth: a node is
owned by the family of its smallest member, every node above it is in that family's trie too, so
each family adds its own nodes up its trie, and what the families found for a node is added.

Texts stay where they are read; a turn is 50 bytes from there on. Turns and prefixes are told apart by
256-bit and 128-bit digests. The numbers of the conversations that end in a node are joined in
blocks of 8,192 ids at most, and a node's blocks run through SHA-256 one after the other, which is
all that one task does for a prefix in which a third of all conversations end. Parents of more
than a thousandth of all nodes are broadcast (there are fewer than a thousand).

Defined cases: a null role or text counts as empty, and a null turn comes first; turns of equal
number are ordered by their digests, so the result is the same each time, and repeated rows are
turns each; rows of a null conv_id take no part; an empty table gives an empty result; texts of
any length are digested where they are read; other columns are ignored, whatever their names. A
family's digests are held by one task, so a single conversation may have as many turns as a
worker's memory holds at 50 bytes each, some ten millions.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.joins import looked_up
from lattica.session import settled, ship, written

FAMILY = 20
HEADS = 4  # a conversation takes fewer than so many turns of its base
ROOT = bytes(16)
_BLANKS = "[\\x20\\x09-\\x0D]+"
_BLOCK_BITS = 13
_NODES = "base long, key binary, parent binary, depth long, members long, first long, words long, ends array<long>"


def base_of(conv: Column) -> Column:
    return conv - conv % FAMILY


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, base, turn, what (digest of role and text) and words of every turn."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    what = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.size(F.array_remove(F.split(text, _BLANKS), ""))
    conv = F.col("conv_id").cast("long")
    return conversations.where(conv.isNotNull()).select(conv.alias("conv_id"), base_of(conv).alias("base"), "turn", what.alias("what"), words.cast("long").alias("words"))


def heads(conv: Column) -> Column:
    """How many of its base's turns a conversation takes."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def _by_conversation(t: pa.Table) -> dict[int, tuple[int, list[bytes], list[int]]]:
    """heads, digests and words in the order of the turns, for each conv_id."""
    order = pc.sort_indices(t, sort_keys=[("conv_id", "ascending"), ("turn", "ascending"), ("what", "ascending")], null_placement="at_start")
    t = t.take(order)
    convs = t["conv_id"].to_pylist()
    what, words, head = t["what"].to_pylist(), t["words"].to_pylist(), t["heads"].to_pylist()
    out, i = {}, 0
    while i < len(convs):
        j = i
        while j < len(convs) and convs[j] == convs[i]:
            j += 1
        out[convs[i]] = head[i], what[i:j], words[i:j]
        i = j
    return out


def _family(key: tuple, of_base: pa.Table, others: pa.Table) -> pa.Table:
    """The trie of one family, a row for each node."""
    (base,) = (k.as_py() for k in key)
    found = _by_conversation(of_base)
    _, head_what, head_words = found.get(base, (0, [], []))
    found |= _by_conversation(others)
    place = {ROOT: 0}
    keys, parents, depths, members, first, count, ends = [ROOT], [None], [0], [0], [min(found)], [0], [[]]
    for conv in sorted(found):
        taken, what, words = found[conv]
        members[0] += 1
        at, path = 0, ROOT
        for d, (turn, n) in enumerate(zip(head_what[:taken] + what[taken:], head_words[:taken] + words[taken:], strict=True), 1):
            above, path = path, hashlib.blake2b(path + turn, digest_size=16).digest()
            at = place.setdefault(path, len(keys))
            if at == len(keys):
                for column, value in zip((keys, parents, depths, members, first, count, ends), (path, above, d, 0, conv, n, []), strict=True):
                    column.append(value)
            members[at] += 1
        ends[at].append(conv)
    i, b = pa.int64(), pa.binary()
    columns = [pa.array([base] * len(keys), i), pa.array(keys, b), pa.array(parents, b), pa.array(depths, i), pa.array(members, i), pa.array(first, i), pa.array(count, i), pa.array(ends, pa.list_(i))]
    return pa.table(columns, names=["base", "key", "parent", "depth", "members", "first", "words", "ends"])


def family_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of every family's trie."""
    ship(conversations.sparkSession)
    rows = turns(conversations).withColumn("heads", heads(F.col("conv_id")))
    own = F.col("conv_id") == F.col("base")
    return rows.where(own).groupBy("base").cogroup(rows.where(~own).groupBy("base")).applyInArrow(_family, _NODES)


def _upwards(key: tuple, nodes: pa.Table, owned: pa.Table) -> pa.Table:
    """What the owned nodes of a family add to each node of its trie."""
    keys, parents, depths = (nodes[c].to_pylist() for c in ("key", "parent", "depth"))
    place = {k: i for i, k in enumerate(keys)}
    leaves, saved = [0] * len(keys), [0] * len(keys)
    for k, leaf, s in zip(owned["key"].to_pylist(), owned["leaf"].to_pylist(), owned["saved"].to_pylist(), strict=True):
        leaves[place[k]], saved[place[k]] = int(leaf), s
    for i in sorted(range(len(keys)), key=depths.__getitem__, reverse=True):
        if parents[i] is not None:
            above = place[parents[i]]
            leaves[above] += leaves[i]
            saved[above] += saved[i]
    kept = [i for i in range(len(keys)) if leaves[i] or saved[i]]
    return pa.table([pa.array([keys[i] for i in kept], pa.binary()), pa.array([leaves[i] for i in kept], pa.int64()), pa.array([saved[i] for i in kept], pa.int64())], names=["key", "leaves", "saved"])


def _hashed(batches):
    """SHA-256 of each key's blocks, which follow each other."""
    key, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["key", "ends_sha256"])

    keys: list[bytes] = []
    found: list[str] = []
    for b in batches:
        for k, text in zip(b["key"].to_pylist(), b["text"].to_pylist(), strict=True):
            if k == key:
                digest.update(b"," + text.encode())
                continue
            if digest is not None:
                keys.append(key)
                found.append(digest.hexdigest())
            key, digest = k, hashlib.sha256(text.encode())
        if len(keys) > 10_000:
            yield done()
            keys, found = [], []
    if digest is not None:
        keys.append(key)
        found.append(digest.hexdigest())
        yield done()


def ends_hashes(nodes: DataFrame) -> DataFrame:
    """key and the hash of the conversations that end there, of every node that has any."""
    ids = nodes.where(F.size("ends") > 0).select("key", F.explode("ends").alias("conv"))
    blocks = ids.groupBy("key", F.shiftright("conv", _BLOCK_BITS).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("text"))
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(n, "key").sortWithinPartitions("key", "block").select("key", "text").mapInArrow(_hashed, "key binary, ends_sha256 string")


def merged(nodes: DataFrame) -> DataFrame:
    """The nodes of all families as one trie: key, parent, depth, members, first (smallest member), words and children."""
    every = written(nodes.groupBy("key").agg(F.min("parent").alias("parent"), F.max("depth").alias("depth"), F.sum("members").alias("members"), F.min("first").alias("first"), F.max("words").alias("words")), "merged")
    below = every.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("children"))
    return every.join(below, "key", "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long")))


def subtree_sums(nodes: DataFrame, trie: DataFrame) -> DataFrame:
    """key, leaves and saved (tokens) of every node's subtree."""
    owned = trie.select(base_of(F.col("first")).alias("base"), "key", (F.col("children") == 0).alias("leaf"), ((F.col("members") - 1) * F.col("words")).alias("saved"))
    found = nodes.select("base", "key", "parent", "depth").groupBy("base").cogroup(owned.groupBy("base")).applyInArrow(_upwards, "key binary, leaves long, saved long")
    return found.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: the contract's columns."""

    def make() -> DataFrame:
        nodes = written(family_nodes(conversations), "families")
        trie = written(merged(nodes), "trie")
        above = trie.where("children > 0").select(F.col("key").alias("parent"), F.col("first").alias("parent_conv_id"), F.col("children").alias("siblings"))
        found = looked_up(trie, above, ["parent"], F.col("siblings"), trie.count()).drop("siblings")
        found = found.join(subtree_sums(nodes, trie), "key", "left").join(ends_hashes(nodes), "key", "left")
        return found.select(
            F.col("first").alias("conv_id"), "depth", "parent_conv_id", F.col("members").alias("n_convs"), F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )

    return settled(make, "prefixes")
