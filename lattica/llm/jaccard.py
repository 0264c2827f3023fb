"""Near-duplicate join on word shingles: MinHash LSH forest with exact verification.

Texts with the same words are one class. Each class has a MinHash signature, read as TREES labels
of DEPTH values. A tree is a prefix trie of its labels: sorted, so the classes below a node are
neighbours. The subtrees below the nodes of depth `shortest_prefix` are dealt out; there a pair at
the threshold still meets in some tree with the target recall. In its subtree a class matches with
its whole label first, and its prefix is shortened a value at a time, until what it has found there
lets the target recall be reached at that depth: each pair found counts for as many as its
estimated similarity says are missed (1 / s^depth), and the mean of their chances to be found in
some tree has to be the target or more. A class that finds nothing is shortened to the end. So
close groups are matched deep in the trie, single classes at its shortest prefix.

Pairs whose signatures agree far less than the threshold asks are dropped, the others link into
candidate groups; then shingle sets are compared exactly for all pairs of a candidate group, so a
group's links are complete whatever tree found it.

A large subtree or group is split into blocks, and block is compared against block; in a large
group only blocks of sizes that the threshold allows meet. A task counts links and emits at most
one edge a member (a spanning forest), never all pairs. Copies are collapsed beforehand and
re-joined by class. Class keys are 64-bit hashes of the words: at 10^10 classes about three pairs
would be expected to share one.

Result, a row for each row of docs: doc_id; class_id, the smallest doc_id with the same words;
group_id, the smallest doc_id reachable over links; n_links, the number of other documents whose
similarity is at least the threshold, copies included.

Defined cases: a text of 1 to SHINGLE-1 words is one shingle; a null text or one without words
is a class of its own without links; a null doc_id takes no part (null class, null group, no
links); rows that repeat doc_id and text count as copies; rows that repeat a doc_id with other texts
are judged each by its text; an empty table gives an empty result; other columns are ignored,
whatever their names. A text longer than a slice is worked on alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm import bloom
from lattica.llm import text as tx
from lattica.operators.graph import connected_components
from lattica.session import fan_out, ship, written

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 20, 8
RECALL = 0.999
SLACK = 0.15  # signatures that agree by less than the threshold minus this (4.7 standard errors) are no candidates
NODE_BLOCK, GROUP_BLOCK = 512, 512
_PAIRS = 100_000  # compared at a time
_SEED = 20_011
_MEMBER = ("k", "class_id", "component", "copies", "n")


def found_in_some_tree(similarity, depth: int, trees: int = TREES):
    """The chance that a pair shares a prefix of a length in one tree or more."""
    return 1 - (1 - similarity**depth) ** trees


def shortest_prefix(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target recall."""
    d = depth
    while d > 1 and found_in_some_tree(threshold, d, trees) < recall:
        d -= 1
    return d


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(_SEED)
    return r.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def shingles(w: tx.Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of each text, where each text's begin, and a key of each text's words."""
    h = w.hashes()
    sh, begin = tx.windows(h, w.word_at, n)
    counts = w.counts
    pos = (np.arange(len(h)) - np.repeat(w.word_at[:-1], counts)).astype(np.uint64)
    terms = tx.mix(h ^ tx.mix(pos + np.uint64(7)))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)])
    key = tx.mix(total[w.word_at[1:]] - total[w.word_at[:-1]] + counts.astype(np.uint64))
    at = np.searchsorted(begin, w.word_at)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        sh = np.insert(sh, at[short], key[short])
        extra = np.zeros(len(counts) + 1, dtype=np.int64)
        extra[short + 1] = 1
        at = at + np.cumsum(extra)
    return sh, at, key


def _signatures(trees: int, depth: int, n: int):
    a, b = _multipliers(trees * depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, limit=1 << 19):
            sh, at, key = shingles(tx.words(batch["text"]), n)
            full = np.flatnonzero(at[1:] > at[:-1])
            sig = np.zeros((len(full), len(a)), dtype="<u2")
            if len(full):
                for k in range(len(a)):
                    sig[:, k] = np.minimum.reduceat((sh * a[k] + b[k]) >> np.uint64(16), at[full]) >> np.uint64(16)
            sigs = np.full(batch.num_rows, None, dtype=object)
            sigs[full] = [s.tobytes() for s in sig]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["t"], pa.array(key.view(np.int64)), pa.array(list(sigs), pa.binary())], ["doc_id", "t", "k", "sig"])

    return run


def _subtrees(trees: int, depth: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            sig = np.frombuffer(b"".join(b["sig"].to_pylist()), "<u2").reshape(n, trees, depth).astype(np.uint64)
            h = np.broadcast_to(tx.mix(np.arange(trees, dtype=np.uint64) + np.uint64(1)), (n, trees))
            for d in range(shortest):
                h = tx.mix(h ^ (sig[:, :, d] + np.uint64(0x10001) * np.uint64(d + 1)))
            k = np.repeat(b["k"].to_numpy(), trees)
            tree = np.tile(np.arange(trees, dtype=np.int32), n)
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(tree), pa.array(k)], ["g", "tree", "k"])

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index in each element's component, given linked pairs."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        keep = root[i] != root[j]
        i, j = i[keep], j[keep]
    return root


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut so that each holds whole groups."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        cols = [b[k].to_numpy() for k in keys]
        if held:
            last = [h[k][h.num_rows - 1].as_py() for h in held[-1:] for k in keys]
            differs = np.flatnonzero(np.any([c != x for c, x in zip(cols, last, strict=True)], axis=0))
            cut = int(differs[0]) if len(differs) else b.num_rows
            if cut < b.num_rows:
                yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks().to_batches()[0]
                held, b = [], b.slice(cut)
            else:
                held.append(b)
                continue
        cols = [b[k].to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0))
        if len(change):
            cut = int(change[-1]) + 1
            yield b.slice(0, cut)
            b = b.slice(cut)
        held = [b]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _bounds(cols: list[np.ndarray]) -> np.ndarray:
    change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
    return np.concatenate([[0], change, [len(cols[0])]])


def _agreement(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    parts = [(sig[i[p : p + _PAIRS]] == sig[j[p : p + _PAIRS]]).mean(1) for p in range(0, len(i), _PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def shortened(rest: np.ndarray, sig: np.ndarray, i: np.ndarray, j: np.ndarray, shortest: int, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs among i and j, neighbours below a trie's nodes, and the depth at which each class stopped.

    rest holds each class's label behind the shortest prefix, sig its whole signature. A class's
    prefix is shortened until the pairs found reach the target recall; a pair is compared at the
    depth of its common prefix, if one of the two is still open then."""
    common = shortest + np.cumprod(rest[i] == rest[j], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    longest = shortest + rest.shape[1]
    depth, still = np.full(len(sig), longest), np.ones(len(sig), dtype=bool)
    fi = fj = np.zeros(0, dtype=np.int64)
    fs = np.zeros(0)
    for d in range(longest, shortest - 1, -1):
        depth[still] = d
        new = np.flatnonzero((common == d) & (still[i] | still[j]))
        s = _agreement(sig, i[new], j[new])
        new, s = new[s >= threshold - SLACK], s[s >= threshold - SLACK]
        fi, fj, fs = np.concatenate([fi, i[new]]), np.concatenate([fj, j[new]]), np.concatenate([fs, np.maximum(s, threshold)])
        stands_for = fs**-d
        ends = np.concatenate([fi, fj])
        every = np.bincount(ends, weights=np.tile(stands_for, 2), minlength=len(sig))
        seen = np.bincount(ends, weights=np.tile(stands_for * found_in_some_tree(fs, d, trees), 2), minlength=len(sig))
        still &= (every == 0) | (seen < recall * every)
        if not still.any():
            break
    return fi, fj, depth


def _pairs_below(lim: np.ndarray, block: np.ndarray, apart: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of each group, those of small groups together; only pairs of two blocks where the group is marked."""
    sizes = np.diff(lim)
    for m in np.unique(sizes[(sizes > 1) & (sizes <= 32)]):
        first = lim[:-1][sizes == m]
        x, y = np.triu_indices(int(m), 1)
        step = max(1, 2 * _PAIRS // len(x))
        for p in range(0, len(first), step):
            f = first[p : p + step]
            yield (f[:, None] + x).ravel(), (f[:, None] + y).ravel()
    for g in np.flatnonzero(sizes > 32):
        if apart[g]:
            of = block[lim[g] : lim[g + 1]]
            x, y = np.flatnonzero(of == of[0]), np.flatnonzero(of != of[0])
            yield lim[g] + np.repeat(x, len(y)), lim[g] + np.tile(y, len(x))
        else:
            x, y = np.triu_indices(int(sizes[g]), 1)
            yield lim[g] + x, lim[g] + y


def _candidates(threshold: float, trees: int, shortest: int, recall: float):
    """Edges between classes of one subtree (or two blocks of it) that the shortened prefixes bring together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_group(batches, ["g", "lo", "hi"]):
            k, lows, highs = b["k"].to_numpy(), b["lo"].to_numpy(), b["hi"].to_numpy()
            whole = np.frombuffer(b"".join(b["sig"].to_pylist()), "<u2").reshape(len(k), trees, -1)
            rest = whole[np.arange(len(k)), b["tree"].to_numpy(), shortest:]
            sig = whole.reshape(len(k), -1).astype(np.uint8)
            lim = _bounds([b["g"].to_numpy(), lows, highs])
            ai, aj = [], []
            for i, j in _pairs_below(lim, b["block"].to_numpy(), (lows != highs)[lim[:-1]]):
                if not len(i):
                    continue
                low, high = int(min(i.min(), j.min())), int(max(i.max(), j.max())) + 1
                fi, fj, _ = shortened(rest[low:high], sig[low:high], i - low, j - low, shortest, threshold, trees, recall)
                ai.append(fi + low)
                aj.append(fj + low)
            i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (ai, aj))
            root = _roots(len(k), i, j)
            linked = np.flatnonzero(root != np.arange(len(k)))
            yield pa.RecordBatch.from_arrays([pa.array(k[linked]), pa.array(k[root[linked]])], ["src", "dst"])
        tx.release()

    return run


def _sets(n: int):
    """The sorted distinct shingles of the texts of wanted classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches):
            sh, at, key = shingles(tx.words(b["text"]), n)
            same = np.flatnonzero(key.view(np.int64) == b["k"].to_numpy())
            sets = [np.unique(sh[at[i] : at[i + 1]]).tobytes() for i in same]
            size = pa.array([len(x) // 8 for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b[c].take(pa.array(same)) for c in _MEMBER), size, pa.array(sets, pa.binary())], [*_MEMBER, "size", "shingles"])

    return run


def _matrix(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """0/1 matrices over the shingles that two or more of the sets hold, some columns at a time."""
    every = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, of = every[order], of[order]
    new = np.ones(len(every), dtype=bool)
    new[1:] = every[1:] != every[:-1]
    col = np.cumsum(new) - 1
    count = np.bincount(col)
    shared = count > 1
    keep = shared[col]
    col, of = (np.cumsum(shared) - 1)[col[keep]], of[keep]
    n, step = int(shared.sum()), 4096
    edges = np.searchsorted(col, np.arange(0, n + step, step))
    for p in range(len(edges) - 1):
        if edges[p] < edges[p + 1]:
            m = np.zeros((len(sets), min(step, n - p * step)), dtype=np.float32)
            m[of[edges[p] : edges[p + 1]], col[edges[p] : edges[p + 1]] - p * step] = 1
            yield m


def _verify(threshold: float):
    """For pairs of a candidate group (or of two blocks of it): links of each class and a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_group(batches, ["component", "lo", "hi"]):
            every, copies, block = b["k"].to_numpy(), b["copies"].to_numpy(), b["block"].to_numpy()
            lows, highs, packed = b["lo"].to_numpy(), b["hi"].to_numpy(), b["shingles"]
            links, every_row, roots = [], [], []
            lim = _bounds([b["component"].to_numpy(), lows, highs])
            for lo, hi in zip(lim[:-1], lim[1:], strict=True):
                _, first = np.unique(every[lo:hi], return_index=True)  # a class can come once a repeated row
                rows = lo + first
                if len(rows) < 2:
                    continue
                sets = [np.frombuffer(packed[int(i)].as_py(), "<u8") for i in rows]
                size = np.array([len(s) for s in sets], dtype=np.float64)
                inter = np.zeros((len(rows), len(rows)))
                for m in _matrix(sets):
                    inter += m @ m.T
                both = size[:, None] + size - inter
                ok = inter >= threshold * both - 1e-9
                np.fill_diagonal(ok, False)
                if lows[lo] != highs[lo]:
                    ok &= block[rows][:, None] != block[rows]
                i, j = np.nonzero(np.triu(ok))
                root = _roots(len(rows), i, j)
                links.append((ok * copies[rows]).sum(1))
                every_row.append(rows)
                roots.append(rows[root])
            n, i, j = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64) for x in (links, every_row, roots))
            ends = [pa.StructArray.from_arrays([b["class_id"].take(pa.array(x)), b["k"].take(pa.array(x))], ["class_id", "k"]) for x in (i, j)]
            yield pa.RecordBatch.from_arrays([pa.array(every[i]), pa.array(n), *ends], ["k", "links", "src", "dst"])
        tx.release()

    return run


def _dealt(members: DataFrame, n: str, size: int) -> DataFrame:
    """members with block, lo and hi: a row for each pair of blocks that a member's block is in."""
    blocks = F.ceil(F.col(n) / size).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("lo", F.least("block", "y")).withColumn("hi", F.greatest("block", "y")).drop("y", "blocks")


def _dealt_by_size(sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """sets with own block, lo and hi: a row for each pair of blocks that can hold links of the member.

    The members of a large group are put into bands of sizes, a factor of 1 / threshold wide; links
    join members of one band or of neighbouring ones. A band is split into blocks by hash."""
    banded = sets.withColumn("band", F.when(F.col("n") > block, F.floor(F.log(F.col("size").cast("double")) / (math.log(1 / threshold) * (1 + 1e-6)))).otherwise(0).cast("int"))
    blocks = banded.where(F.col("n") > block).groupBy("component", "band").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    per_group = blocks.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("bands"))  # a few dozen bands
    rows = banded.join(per_group, "component", "left")
    count = lambda b: F.coalesce(F.try_element_at("bands", b), F.lit(0))
    code = lambda band, x: (band.cast("long") * (1 << 32) + x).alias("c")
    band = F.col("band")
    own = F.coalesce(F.pmod(F.xxhash64("k"), F.greatest(count(band), F.lit(1))), F.lit(0))
    mine = code(band, own)

    def with_band(b: Column) -> Column:
        ys = F.when(count(b) > 0, F.sequence(F.lit(0), count(b) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(ys, lambda y: F.struct(F.least(mine, code(b, y)).alias("lo"), F.greatest(mine, code(b, y)).alias("hi")))

    cells = F.when(F.col("bands").isNull(), F.array(F.struct(mine.alias("lo"), mine.alias("hi")))).otherwise(F.concat(*(with_band(band + d) for d in (-1, 0, 1))))
    return rows.withColumn("block", mine).withColumn("cell", F.explode(cells)).select("component", "cell.lo", "cell.hi", "k", "class_id", "block", "copies", "shingles")


def _judged(docs: DataFrame, threshold: float, n: int, trees: int, depth: int, recall: float) -> DataFrame:
    """doc_id, t (the text's hash), unit (one number for each group), class_id, group_id and n_links of the rows with a doc_id."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = fan_out(docs.select("text"), 16 << 20)
    texts = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    signed = written(texts.mapInArrow(_signatures(trees, depth, n), f"doc_id {kind}, t long, k long, sig binary"), "signatures")
    worded = signed.where("sig is not null")
    classes = written(worded.groupBy("k").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "classes")

    shortest = shortest_prefix(threshold, trees, depth, recall)
    nodes = classes.select("k", "sig").mapInArrow(_subtrees(trees, depth, shortest), "g long, tree int, k long")
    peopled = nodes.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    below = _dealt(nodes.join(peopled, "g"), "n", NODE_BLOCK).join(classes.select("k", "sig"), "k").select("g", "lo", "hi", "block", "tree", "k", "sig")
    below = below.repartition(parts, "g", "lo", "hi").sortWithinPartitions("g", "lo", "hi")
    edges = below.mapInArrow(_candidates(threshold, trees, shortest, recall), "src long, dst long")
    groups = connected_components(edges).withColumnRenamed("node", "k")

    sizes = written(groups.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    wanted = written(classes.join(groups.join(sizes, "component"), "k").select("k", "class_id", "copies", "component", "n"), "wanted")
    ids = wanted.withColumn("doc_id", F.col("class_id"))
    needed = bloom.tested(texts, "doc_id", bloom.build(ids, "doc_id"), "maybe").where("maybe").drop("maybe")  # only these texts are shuffled
    sets = needed.join(ids, "doc_id").select("text", *_MEMBER)
    sets = written(sets.mapInArrow(_sets(n), f"k long, class_id {kind}, component long, copies long, n long, size long, shingles binary"), "sets")
    found = _dealt_by_size(sets, threshold, GROUP_BLOCK).repartition(parts, "component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    end = f"struct<class_id:{kind},k:bigint>"
    found = written(found.mapInArrow(_verify(threshold), f"k long, links long, src {end}, dst {end}"), "links")
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    # nodes are ordered by class_id, so a component's smallest node holds the group's id
    linked = connected_components(found).select(F.col("node.k").alias("k"), F.col("component.k").alias("unit"), F.col("component.class_id").alias("group_id"))
    per_class = classes.select("k", "class_id", "copies").join(links, "k", "left").join(linked, "k", "left")
    per_class = per_class.select("k", "class_id", F.coalesce("unit", "k").alias("unit"), F.coalesce("group_id", "class_id").alias("group_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    per_class = written(per_class, "judged")  # a class of many copies is split when it is joined back

    out = worded.select("doc_id", "t", "k").join(per_class, "k").select("doc_id", "t", "unit", "class_id", "group_id", "n_links")
    alone = signed.where("sig is null").select("doc_id", "t", F.lit(None).cast("long").alias("unit"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, group_id, n_links of every row of docs (doc_id, text)."""
    found = _judged(docs, threshold, n, trees, depth, recall).select("doc_id", "class_id", "group_id", "n_links")
    empty = F.lit(None).cast(docs.schema["doc_id"].dataType)
    nameless = docs.where("doc_id is null").select(empty.alias("doc_id"), empty.alias("class_id"), empty.alias("group_id"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(nameless)


def near_duplicate_stage(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group the document with the
    smallest doc_id (of several texts of that doc_id in the group, one). Rows without a doc_id stay;
    of rows that repeat doc_id and text, one stays.

    Only rows whose id a Bloom filter of dropped and repeated ids passes are shuffled."""
    mark = "__lattica_"
    found = _judged(docs, THRESHOLD, SHINGLE, TREES, DEPTH, RECALL).groupBy("doc_id", "t", "unit", "group_id").agg(F.count("*").alias("n"))
    heads = found.where("doc_id = group_id")
    first = heads.where("unit is not null").groupBy("unit").agg(F.min("t").alias("first_t"))
    dropped = F.coalesce(F.col("t") != F.col("first_t"), F.lit(False))
    judged = heads.join(first, "unit", "left").select("doc_id", "t", "n", dropped.alias(f"{mark}dropped")).unionByName(found.where("doc_id <> group_id").select("doc_id", "t", "n", F.lit(True).alias(f"{mark}dropped")))
    special = written(judged.where(f"{mark}dropped or n > 1").select("doc_id", F.col("t").alias(f"{mark}t"), f"{mark}dropped"), "special")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")  # names of other columns can't clash
    tested = bloom.tested(rows, "doc_id", bloom.build(special, "doc_id"), f"{mark}maybe")
    sure = tested.where(f"not {mark}maybe or doc_id is null").select("row")
    rest = tested.where(f"{mark}maybe and doc_id is not null").withColumn(f"{mark}t", F.xxhash64("text"))
    rest = rest.join(special, ["doc_id", f"{mark}t"], "left").where(f"not coalesce({mark}dropped, false)").dropDuplicates(["doc_id", f"{mark}t"])
    return sure.unionByName(rest.select("row")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
