"""Communities of graphs that no single worker holds, by rounds of moves that don't disturb each other.

A round finds every node's best move by modularity gain. Communities that more nodes want to join than
to leave only take nodes in, the others only give some away. Made one by one, by gain and degree, a move
then gains no less than computed, but for the degrees of those that left its home or joined its goal
before; it is made if its gain outweighs these. So many nodes join one community at once, and the
modularity rises with every round. When few nodes move any more, communities become
the nodes of a smaller graph, and so on until nothing gains, or until one worker holds what is left. At last a
community whose parts aren't linked is taken apart, which can only raise the modularity.

Nodes are numbered from 0, and links are kept as slices: arrays of a range of nodes' links. A round's labels are
arrays too, a block of nodes to a row, so what links and labels need to meet is a few large rows; the rest is
joins and partial sums over nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.graph import connected_components
from lattica.session import dropped, settled, ship, written

LEAST_GAIN = 1e-9
FEW = 20  # a level ends when less than one in so many of its nodes moves
BLOCK = 1_400_000  # nodes whose labels are one row, of 34 MB
SLICE = 1 << 21  # links' ends in a row of slices at most, on average
LEAST_SLICE = 1 << 16  # fewer rows than the workers' cores are made of no smaller slices
NAMES = 32 << 20  # characters of names that are broadcast
WORKER = 200_000  # nodes and links of a smaller graph that one worker searches
GATHERED = 1 << 20  # rows that a task packs at once
TREE = 1 << 22  # nodes whose parts a task holds at once
ROW = "x long, y long, a binary, b binary, w binary"
WANTED = "node long, home long, to long, k double, gain double"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches joined to tables of GATHERED rows or little more."""
    held: list = []
    for b in batches:
        held.append(b)
        if sum(len(h) for h in held) >= GATHERED:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _arrays(table: pa.Table, name: str, kind: str) -> np.ndarray:
    """The arrays of a binary column, one after the other."""
    return np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table[name]] or [np.zeros(0, kind)])


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.strip().split() for f in schema.split(",")]
    return pa.RecordBatch.from_pydict({n: pa.array([r[i].tobytes() if isinstance(r[i], np.ndarray) else r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(fields)})


def _order(key: np.ndarray, most: int) -> np.ndarray:
    """Places in order of a key from 0 to most; a short key is sorted by its digits."""
    return np.argsort(key.astype("u2") if most < 1 << 16 else key, kind="stable")


def _summed(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, in order, the sum of its w, and where the key stands."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, "i8")
    return key[first], np.add.reduceat(w[order], first) if len(first) else w[:0], order[first]


def _slices(at: DataFrame, n: int, links: int) -> DataFrame:
    """x, y, a, b, w: the links of the x-th range of nodes with the y-th block of nodes, in both directions, each pair once, without loops; written."""
    each = min(SLICE, max(LEAST_SLICE, links // (2 * at.sparkSession.sparkContext.defaultParallelism)))
    width, block = max(1, -(-n * each // max(1, 2 * links))), BLOCK
    across = -(-n // width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches):
            a, b, w = (t[c].to_numpy() for c in "abw")
            a, b, w = np.r_[a, b], np.r_[b, a], np.r_[w, w]
            cell = b // block * across + a // width
            order = _order(cell, n // block * across + across)
            a, b, w, cell = a[order], b[order], w[order], cell[order]
            cut = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            for i, j in zip(cut, [*cut[1:], len(cell)], strict=True):
                yield _rows(ROW, [(int(cell[i]) % across, int(cell[i]) // across, a[i:j], b[i:j], w[i:j])])

    def join(t: pa.Table) -> pa.Table:
        low = t["x"][0].as_py() * width
        key, w, _ = _summed((_arrays(t, "a", "i8") - low) * n + _arrays(t, "b", "i8"), _arrays(t, "w", "f8"))
        return pa.Table.from_batches([_rows(ROW, [(t["x"][0].as_py(), t["y"][0].as_py(), key // n + low, key % n, w)])])

    tasks = max(int(at.sparkSession.conf.get("spark.sql.shuffle.partitions")), across)
    parts = at.where("a <> b").select("a", "b", "w").mapInArrow(pack, ROW)
    return written(parts.repartition(tasks, "x", "y").groupBy("x", "y").applyInArrow(join, ROW), "slices")


def _blocks(label: DataFrame) -> DataFrame:
    """y, c, v, k: each block's communities, their volumes and the nodes' degrees as arrays; label: node, community, k."""
    block = BLOCK

    def pack(t: pa.Table) -> pa.Table:
        node, c, v, k = (t[x].to_numpy() for x in ("node", "community", "volume", "k"))
        y = int(node[0]) // block
        out = np.zeros(node.max() + 1 - y * block, "i8"), np.zeros(node.max() + 1 - y * block), np.zeros(node.max() + 1 - y * block)
        for o, values in zip(out, (c, v, k), strict=True):
            o[node - y * block] = values
        return pa.Table.from_batches([_rows("y long, c binary, v binary, k binary", [(y, *out)])])

    volume = label.groupBy("community").agg(F.sum("k").alias("volume"))
    rows = label.join(volume, "community").select("node", "community", "volume", "k", F.floor(F.col("node") / block).alias("y"))
    return rows.groupBy("y").applyInArrow(pack, "y long, c binary, v binary, k binary")


def _best(a, c, v, w, own_c, own_v, own_k, n: int, twice: float, resolution: float, low: int) -> pa.RecordBatch:
    """The nodes that gain by a move: a, c, v, w are links' ends, the communities they lead to, volumes and weights; own_ those of node low and those behind it."""
    key, toward, at = _summed((a - low) * n + c, w)
    node, c, v = key // n, key % n, v[at]
    k, home = own_k[node], own_c[node]
    gain = np.round(toward - resolution * (v - np.where(c == home, k, 0.0)) * k / twice, 12)
    now = np.round(-resolution * (own_v - own_k) * own_k / twice, 12)
    now[node[c == home]] = gain[c == home]
    gain[c == home] = -np.inf
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, "i8")
    most = np.maximum.reduceat(gain, first) if len(first) else gain
    place = np.full(len(own_c), -1)
    top = np.flatnonzero(gain == np.repeat(most, np.diff(np.r_[first, len(node)])))
    place[node[top]] = top  # of equals the last, which is the greatest community
    p = place[node[first]]
    p = p[gain[p] > now[node[p]] + LEAST_GAIN]
    return pa.RecordBatch.from_arrays([pa.array(z) for z in (node[p] + low, home[p], c[p], k[p], gain[p] - now[node[p]])], ["node", "home", "to", "k", "gain"])


def _wanted(slices: DataFrame, label: DataFrame, n: int, twice: float, resolution: float) -> DataFrame:
    """node, home, to, k, gain: each node's best move, where it gains; slices as `_slices` makes them."""
    blocks, block = _blocks(label), BLOCK

    def own(t: pa.Table, low: int, high: int) -> tuple:
        at = low // block * block
        return tuple(np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in t[x]])[low - at : high - at] for x, kind in (("c", "i8"), ("v", "f8"), ("k", "f8")))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # one block has all labels
        for batch in batches:
            for i in range(len(batch)):
                t = pa.Table.from_batches([batch.slice(i, 1)])
                a, b, w = _arrays(t, "a", "i8"), _arrays(t, "b", "i8"), _arrays(t, "w", "f8")
                c, v = _arrays(t, "c", "i8"), _arrays(t, "v", "f8")
                low, high = int(a[0]), int(a[-1]) + 1
                yield _best(a, c[b], v[b], w, *own(t, low, high), n, twice, resolution, low)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                t = pa.Table.from_batches([batch.slice(i, 1)])
                a, b, w = _arrays(t, "a", "i8"), _arrays(t, "b", "i8") - t["y"][0].as_py() * block, _arrays(t, "w", "f8")
                c, v = _arrays(t, "c", "i8")[b], _arrays(t, "v", "f8")[b]
                key, toward, at = _summed((a - a[0]) * n + c, w)
                cut = np.flatnonzero(np.r_[True, np.diff((key // n + a[0]) // block) > 0])  # a slice may reach into a second block
                for p, q in zip(cut, [*cut[1:], len(key)], strict=True):
                    yield _rows("x long, z long, a binary, c binary, v binary, w binary", [(t["x"][0].as_py(), int((key[p] // n + a[0]) // block), key[p:q] // n + a[0], key[p:q] % n, v[at[p:q]], toward[p:q])])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                t = pa.Table.from_batches([batch.slice(i, 1)])
                a, c, v, w = _arrays(t, "a", "i8"), _arrays(t, "to", "i8"), _arrays(t, "volume", "f8"), _arrays(t, "w", "f8")
                low, high = int(a.min()), int(a.max()) + 1
                yield _best(a, c, v, w, *own(t, low, high), n, twice, resolution, low)

    def united(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_rows("z long, a binary, to binary, volume binary, w binary", [(t["z"][0].as_py(), *(_arrays(t, x, k) for x, k in (("a", "i8"), ("c", "i8"), ("v", "f8"), ("w", "f8"))))])])

    if n <= block:
        return slices.drop("y").crossJoin(F.broadcast(blocks)).mapInArrow(whole, WANTED)
    copies = 16  # of a block, so that its links are dealt out
    spread = blocks.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    met = slices.withColumn("s", F.pmod("x", F.lit(copies)).cast("int")).join(spread, ["y", "s"])
    sums = met.select("x", "y", "a", "b", "w", "c", "v").mapInArrow(part, "x long, z long, a binary, c binary, v binary, w binary").groupBy("x", "z").applyInArrow(united, "z long, a binary, to binary, volume binary, w binary")
    sums = sums.withColumn("s", F.pmod(F.xxhash64("a"), F.lit(copies)).cast("int"))
    return sums.join(spread.withColumnRenamed("y", "z"), ["z", "s"]).mapInArrow(best, WANTED)


def _moves(wanted: DataFrame, twice: float, resolution: float, turn: int) -> tuple[DataFrame, int]:
    """node, next (the new community), written, and their number: a round's moves.

    wanted: node, home, to, k, gain, written. turn decides for communities that as many want to join as to leave."""
    ends = wanted.select(F.explode(F.array(F.struct(F.col("home").alias("community"), F.lit(-1).alias("way")), F.struct(F.col("to").alias("community"), F.lit(1).alias("way")))).alias("e"))
    takes = F.sum("e.way") * 2 + F.pmod(F.xxhash64("e.community", F.lit(turn)), F.lit(2)) > 0
    side = ends.groupBy("e.community").agg(takes.alias("takes"))
    able = wanted.join(side.where("not takes").select(F.col("community").alias("home")), "home").join(side.where("takes").select(F.col("community").alias("to")), "to")
    before = lambda c: F.coalesce(F.sum("k").over(Window.partitionBy(c).orderBy(F.desc("each"), "node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    able = able.withColumn("each", F.col("gain") / F.col("k")).withColumn("lost", resolution * (before("home") + before("to")) / twice)
    moves = written(able.where(F.col("each") > F.col("lost")).select("node", F.col("to").alias("next")), "moves")
    n = moves.count()
    if not n:  # the best of both its communities, of which there is one if anything gains
        dropped(moves)
        bids = wanted.select(F.explode(F.array("home", "to")).alias("community"), F.struct("gain", "node").alias("bid")).groupBy("community").agg(F.max("bid").alias("bid"))
        first = bids.select("community", F.col("bid.node").alias("node"))
        moves = written(wanted.join(first.select(F.col("community").alias("home"), "node"), ["home", "node"]).join(first.select(F.col("community").alias("to"), "node"), ["to", "node"]).select("node", F.col("to").alias("next")), "moves")
        n = moves.count()
    dropped(wanted)
    return moves, n


def _numbered(nodes: DataFrame) -> DataFrame:
    """node, id: the distinct nodes, numbered from 0 without gaps; written."""
    rows = written(nodes.select("node").distinct().withColumn("m", F.monotonically_increasing_id()), "rows")
    part, rest = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("c"))  # a row for each task that wrote
    first = counts.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("first"))
    out = written(rows.join(F.broadcast(first), part == F.col("part")).select("node", (F.col("first") + rest).alias("id")), "names")
    dropped(rows)
    return out


def _degrees(at: DataFrame, slices: DataFrame) -> DataFrame:
    """node, k: the weights of each node's links, those to itself twice."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                t = pa.Table.from_batches([batch.slice(i, 1)])
                node, k, _ = _summed(_arrays(t, "a", "i8"), _arrays(t, "w", "f8"))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(k)], ["node", "k"])

    loops = at.where("a = b").select(F.col("a").alias("node"), (2 * F.col("w")).alias("k"))
    return slices.select("a", "w").mapInArrow(sums, "node long, k double").unionByName(loops).groupBy("node").agg(F.sum("k").alias("k"))


def _placed(at: DataFrame, label: DataFrame, n: int) -> DataFrame:
    """at (a, b, w) with the labels of its ends, x and y; label: node, label."""
    side = F.broadcast if n <= BLOCK else lambda d: d
    return at.join(side(label.toDF("a", "x")), "a").join(side(label.toDF("b", "y")), "b")


def _by_one(at: DataFrame, resolution: float) -> DataFrame:
    """node, community: the search of one worker over a graph of WORKER nodes and links at most."""

    def search(t: pa.Table) -> pa.Table:
        from lattica.operators import cluster

        links = dict(zip(zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True), t["w"].to_pylist(), strict=True))
        found = cluster.communities(sorted({x for pair in links for x in pair}), links, resolution)
        return pa.table({"node": pa.array(list(found), pa.int64()), "community": pa.array(list(found.values()), pa.int64())})

    return at.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(search, "node long, community long")


def _searched(at: DataFrame, degree: DataFrame, slices: DataFrame, n: int, links: int, twice: float, resolution: float, start: DataFrame | None) -> DataFrame:
    """id, group: communities of the nodes 0 to n - 1; at: a, b, w, written, with its degrees and slices; start: node, community, both numbers."""
    spark = at.sparkSession
    names, turn, level = None, 0, 0
    while True:
        every = spark.range(n).select(F.col("id").alias("node"))
        label = every.withColumn("community", F.col("node")) if start is None else every.join(start, "node")
        start, alone, level = None, start is None, level + 1
        if level > 1 and n + links <= WORKER:
            found = written(every.join(_by_one(at, resolution), "node", "left").select("node", F.coalesce("community", "node").alias("community")), "label")
            return names.join(found.toDF("group", "community"), "group").select("id", F.col("community").alias("group"))
        if level > 1:
            slices = _slices(at, n, links)
            degree = _degrees(at, slices)
        label = written(label.join(degree, "node", "left").na.fill(0.0, ["k"]), "label")
        ever = False
        while True:
            turn += 1
            moves, moved = _moves(written(_wanted(slices, label, n, twice, resolution), "wanted"), twice, resolution, turn)
            if not moved:
                break
            new = written(label.join(moves, "node", "left").select("node", F.coalesce("next", "community").alias("community"), "k"), "label")
            dropped(label, moves)
            label, ever = new, True
            if moved * FEW < n:
                break
        if not ever and alone:
            return names if names is not None else label.select(F.col("node").alias("id"), F.col("community").alias("group"))
        heads = _numbered(label.select(F.col("community").alias("node")))
        renamed = written(label.join(heads.toDF("community", "head"), "community").select("node", "head"), "renamed")
        names = written(renamed.toDF("id", "group") if names is None else names.join(renamed.toDF("group", "head"), "group").select("id", F.col("head").alias("group")), "names")
        at = written(_placed(at, renamed, n).groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")), "links")
        n, links = heads.count(), at.count()


def _tree(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components, each node but the smallest of its part linked to that."""
    ids, ends = np.unique(np.r_[a, b], return_inverse=True)
    a, b, least = *np.split(ends, 2), np.arange(len(ids))
    while (least[a] != least[b]).any():
        x, y = least[a], least[b]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]
    other = np.flatnonzero(least != np.arange(len(ids)))
    return ids[other], ids[least[other]]


def _inner(at: DataFrame, slices: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """a, b: links with the same components as those between nodes of one community; found: id, group."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.zeros(0, "i8")
        for t in _gathered(batches):
            if len(a) > TREE:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                a = b = a[:0]
            a, b = _tree(np.r_[a, t["a"].to_numpy()], np.r_[b, t["b"].to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                t = pa.Table.from_batches([batch.slice(i, 1)])
                a, b, c = (_arrays(t, x, "i8") for x in "abc")
                same = (a < b) & (c[a] == c[b])
                a, b = _tree(a[same], b[same])
                yield pa.RecordBatch.from_arrays([pa.array(c[a]), pa.array(a), pa.array(b)], ["x", "a", "b"])

    if n <= BLOCK:
        links = slices.select("a", "b").crossJoin(F.broadcast(_blocks(found.select(F.col("id").alias("node"), F.col("group").alias("community"), F.lit(0.0).alias("k"))).select("c"))).mapInArrow(within, "x long, a long, b long")
    else:
        links = _placed(at, found, n).where("x = y and a <> b")
    return links.repartition("x").select("a", "b").mapInArrow(stars, "a long, b long")


def compared(nodes: DataFrame, links: DataFrame, resolution: float = 1.0, start: DataFrame | None = None) -> tuple[DataFrame, float, float]:
    """communities() of these, written, and the modularities of the result and of start (zero without), as found by the links' sums."""
    ship(nodes.sparkSession)
    values = [0.0, 0.0]

    def make() -> DataFrame:
        names = _numbered(nodes)
        n, size = names.agg(F.count("*"), F.sum(F.length(F.col("node").cast("string")))).first()
        near = F.broadcast if n <= BLOCK and (size or 0) <= NAMES else lambda d: d
        weighed = links.where("w > 0").select("a", "b", F.col("w").cast("double").alias("w"))
        ends = weighed.join(near(names.toDF("a", "x")), "a").join(near(names.toDF("b", "y")), "b")
        at = written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "w"), "links")
        total = at.agg(F.count("*"), F.sum("w")).first()
        twice, own = 2.0 * (total[1] or 0.0), None
        if start is not None:
            given = names.join(start.select("node", "community"), "node", "left")
            heads = given.where("community is not null").groupBy("community").agg(F.min("id").alias("head"))
            own = written(given.join(heads, "community", "left").groupBy("id").agg(F.coalesce(F.min("head"), "id").alias("own")), "start")
        if not twice:
            return names.select("node", F.col("node").alias("community"))
        slices = _slices(at, n, total[0])
        degree = written(_degrees(at, slices), "degree")

        def whole(first: DataFrame | None) -> DataFrame:
            found = _searched(at, degree, slices, n, total[0], twice, resolution, first)
            linked = _components(_inner(at, slices, found, n)).toDF("id", "component")
            found = found.join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("group"))
            both = found.withColumn("own", F.col("group")) if own is None else found.join(own, "id")
            both = written(both, "found")
            values[:] = _modularities(at, degree, slices, both, n, twice, resolution)
            return both

        both = whole(None)
        if own is not None and values[0] < values[1]:
            both = whole(own.toDF("node", "community"))
        named = both.join(names, "id")
        heads = named.groupBy("group").agg(F.min("node").alias("community"))
        return named.join(heads, "group").select("node", "community")

    return settled(make, "communities"), *values


def _components(links: DataFrame) -> DataFrame:
    """node, component; links (a, b, b being less) that are stars already need no rounds."""
    stars = written(links, "stars")
    once = stars.groupBy("a").count().where("count > 1").isEmpty()
    if once and stars.join(stars.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
        return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))  # the others are their own
    return connected_components(stars, "a", "b")


def _modularities(at: DataFrame, degree: DataFrame, slices: DataFrame, both: DataFrame, n: int, twice: float, resolution: float) -> list[float]:
    """The modularities of two labels; at, degree, slices as in `_searched`; both: id, group, own."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                t = pa.Table.from_batches([batch.slice(i, 1)])
                a, b, w = _arrays(t, "a", "i8"), _arrays(t, "b", "i8"), _arrays(t, "w", "f8")
                yield pa.RecordBatch.from_pydict({x: [float(w[c[a] == c[b]].sum())] for x, c in (("group", _arrays(t, "c", "i8")), ("own", _arrays(t, "d", "i8")))})

    kinds = ("group", "own")
    if n <= BLOCK:
        label = lambda kind, name: _blocks(both.select(F.col("id").alias("node"), F.col(kind).alias("community"), F.lit(0.0).alias("k"))).select(F.col("c").alias(name))
        sums = slices.select("a", "b", "w").crossJoin(F.broadcast(label("group", "c").crossJoin(label("own", "d")))).mapInArrow(within, "group double, own double").agg(*(F.sum(c) for c in kinds)).first()
        loops = at.where("a = b").agg(F.sum("w")).first()[0] or 0.0
        inside = [(x or 0.0) + 2 * loops for x in sums]
    else:
        placed = _placed(at, both.select("id", F.struct(*kinds).alias("label")), n)
        inside = [2 * x for x in placed.agg(*(F.sum(F.when(F.col(f"x.{c}") == F.col(f"y.{c}"), F.col("w")).otherwise(0.0)) for c in kinds)).first()]
    volumes = written(both.join(degree.withColumnRenamed("node", "id"), "id").groupBy(*kinds).agg(F.sum("k").alias("k")), "volumes")
    squares = [volumes.groupBy(c).agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] for c in kinds]
    return [i / twice - resolution * q / twice**2 for i, q in zip(inside, squares, strict=True)]


def communities(nodes: DataFrame, links: DataFrame, resolution: float = 1.0, start: DataFrame | None = None) -> DataFrame:
    """node, community (one of its nodes): communities of an undirected graph.

    nodes: node; links: a, b, w (each pair once; weights above zero count). start: node, community (of the
    nodes' type), a division that is known: the result's modularity is no less than its, because where
    a search from single nodes ends below it, another begins with it."""
    return compared(nodes, links, resolution, start)[0]


def modularity(links: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """The modularity of labels (node, community) on links (a, b, w, each pair once)."""
    placed = links.where("w > 0").join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b")
    inside = placed.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("total")).first()
    if not inside["total"]:
        return 0.0
    volume = placed.select(F.explode(F.array("ca", "cb")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("k"))
    squares = volume.agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return inside["inside"] / inside["total"] - resolution * squares / (2 * inside["total"]) ** 2
