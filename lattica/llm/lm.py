"""Language-model scores by deleted interpolation.

A token's probability mixes the maximum-likelihood bigram, unigram and uniform estimates,
p = l2 * c(h,w)/c(h) + l1 * c(w)/N + l0 / (V+1), with weights for each bucket of the context's
frequency c(h) (a bucket for each power of two, one for unseen contexts). The weights come from
expectation-maximisation on the counts of a held-out fold of the training documents (FOLD), with
estimates from the rest; the final estimates use all training documents. The EM runs on a
histogram of all the fold's tokens by bucket and estimates (EIGHTHS of a power of two), whose
size is bounded by its bins, not by the corpus, until no weight changes by more than TOLERANCE; the
uniform estimate keeps a weight of LEAST_UNIFORM.

Counting moves n-grams once a block: each block of documents sends its distinct token and bigram
hashes with their counts to parts dealt by hash, where they are summed over all blocks, and gets
the sums back in the same order. A frequent word or pair costs an entry a block. The block's
texts travel compressed to where its sums arrive, and are scored there.

Defined cases: a null or empty text is its end token alone; a null doc_id counts as training; an
empty table gives an empty result; without training tokens every estimate but the uniform one is
zero; repeated rows count and are scored each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import text as tx
from lattica.session import fan_out, ship, written

MODULUS, TEST, FOLD = 7, 2, 3  # crc32(doc_id) mod 7: test documents, and the training fold that EM holds out
BLOCK_TOKENS = 1 << 21
BUCKETS = 48
EIGHTHS = 8
TOLERANCE = 1e-6  # EM ends when no weight changes by more
LEAST_UNIFORM = 1e-6  # so that an unseen token never has probability zero
_END, _START = np.uint64(0x5E7D1F0C3A9B2468), np.uint64(0x1F83D9ABFB41BD6B)
_REQUEST, _TEXTS, _SUMS, _STATS = range(4)
_UNI, _BI = 0, 1
_ROW = "part int, kind int, block long, fold boolean, gram int, a binary, b binary, c binary"
_TYPES = [("part", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("fold", pa.bool_()), ("gram", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]


class _Grams:
    """Tokens of the texts of a block: hashes, contexts, and distinct tokens and bigrams in order of hash."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        hashes, counts = [], []
        for b in batches:
            w = tx.words(b["text"], lower=True)
            hashes.append(w.hashes())
            counts.append(w.counts)
        counts = np.concatenate(counts)
        self.n = counts + 1
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        t = np.empty(self.at[-1], dtype=np.uint64)
        ends = self.at[1:] - 1
        body = np.ones(len(t), dtype=bool)
        body[ends] = False
        t[body], t[ends] = np.concatenate(hashes), _END
        context = np.empty_like(t)
        context[1:], context[self.at[:-1]] = t[:-1], _START
        self.uni, self.uni_of = np.unique(t, return_inverse=True)
        self.bi, self.bi_of = np.unique(tx.mix((context ^ _START) * np.uint64(0x9E3779B97F4A7C15) + t), return_inverse=True)
        # a word's count as a context is its count as a token; the start's is that of the end
        start = np.searchsorted(self.uni, _END)
        self.context_of = np.empty(len(t), dtype=np.int64)
        self.context_of[1:] = self.uni_of[:-1]
        self.context_of[self.at[:-1]] = start

    def counted(self, remainder: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Hashes, and their counts in the training documents outside and inside the fold."""
        r = np.repeat(remainder, self.n)
        for gram, keys, of in ((_UNI, self.uni, self.uni_of), (_BI, self.bi, self.bi_of)):
            yield gram, keys, np.bincount(of[(r != TEST) & (r != FOLD)], minlength=len(keys)), np.bincount(of[r == FOLD], minlength=len(keys))


def _small(x: np.ndarray) -> bytes:
    """Counts as a byte each; those of 255 or more stand in full before them, in order."""
    big = x[x >= 255].astype("<u8")
    return len(big).to_bytes(8, "little") + big.tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes()


def _large(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    out = np.frombuffer(x, np.uint8, offset=8 + 8 * n).astype(np.int64)
    out[out == 255] = np.frombuffer(x, "<u8", n, 8).astype(np.int64)
    return out


def _ipc(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        for b in batches:
            w.write_batch(b)
    return sink.getvalue().to_pybytes()


def _requests(parts: int):
    def block_rows(block: int, fold: bool, held: list[pa.RecordBatch]) -> Iterator[tuple]:
        yield (int(block % parts), _TEXTS, block, fold, None, _ipc(held), None, None)
        g = _Grams(held)
        remainder = np.concatenate([b["remainder"].to_numpy() for b in held])
        for gram, keys, rest, fold_n in g.counted(remainder):
            part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            cut = np.searchsorted(part, np.arange(parts + 1))
            for p in range(parts):
                i, j = cut[p], cut[p + 1]
                if i < j:
                    yield (p, _REQUEST, block, fold, gram, tx.packed(keys[i:j]), _small(rest[i:j]), _small(fold_n[i:j]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        task, n = TaskContext.get().partitionId() << 32, 0
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}
        for b in tx.slices(batches, limit=1 << 20):
            fold = np.asarray(b["remainder"]) == FOLD
            for side in (False, True):
                mine = b.filter(pa.array(fold == side))
                if mine.num_rows:
                    held[side].append(mine)
                    size[side] += len(tx.raw(mine["text"])[0]) // 6 + mine.num_rows
                if size[side] >= BLOCK_TOKENS:
                    yield from block_rows(task + n, side, held[side])
                    held[side], size[side], n = [], 0, n + 1
        for side in (False, True):
            if held[side]:
                yield from block_rows(task + n, side, held[side])
                n += 1

    return lambda batches: tx.batched(rows(batches), _TYPES)


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the counts of a part of the hashes over all blocks and answers each block."""

    def rows() -> Iterator[tuple]:
        asked: dict[int, list] = {_UNI: [], _BI: []}
        part = 0
        for b in batches:
            for row in zip(*(b[n].to_pylist() for n, _ in _TYPES), strict=True):
                part = row[0]
                if row[1] == _TEXTS:
                    yield row
                else:
                    asked[row[4]].append((row[2], row[3], tx.unpacked(row[5]), row[6], row[7]))
        for gram, requests in asked.items():
            if not requests:
                continue
            every = np.concatenate([r[2] for r in requests])
            order = np.argsort(every, kind="stable")
            new = np.ones(len(every), dtype=bool)
            new[1:] = every[order[1:]] == every[order[:-1]]
            new[1:] = ~new[1:]
            key = np.empty(len(every), dtype=np.int64)
            key[order] = np.cumsum(new) - 1
            del every, order
            sums = []
            for c in (3, 4):
                # bincount's float weights are exact for counts below 2**53
                total = np.bincount(key, weights=np.concatenate([_large(r[c]) for r in requests])).astype(np.int64)
                sums.append(total)
            if gram == _UNI:
                rest, fold = sums
                stats = np.array([rest.sum(), fold.sum(), (rest > 0).sum(), (rest + fold > 0).sum()], dtype="<i8")
                yield (part, _STATS, -1, False, gram, stats.tobytes(), None, None)
            at = 0
            for block, fold_side, hashes, _, _ in requests:
                mine = key[at : at + len(hashes)]
                at += len(hashes)
                yield (part, _SUMS, block, fold_side, gram, None, _small(sums[0][mine]), _small(sums[1][mine]))

    return tx.batched(rows(), _TYPES)


class _Answered:
    """A block's texts with the corpus counts of its tokens, contexts and bigrams."""

    def __init__(self, table: pa.Table) -> None:
        sums: dict[int, list] = {_UNI: [], _BI: []}
        texts = b""
        for part, kind, gram, a, b, c in zip(*(table[x].to_pylist() for x in ("part", "kind", "gram", "a", "b", "c")), strict=True):
            if kind == _TEXTS:
                texts = a
            else:
                sums[gram].append((part, b, c))
        self.docs = pa.ipc.open_stream(texts).read_all()
        self.grams = _Grams(self.docs.to_batches())
        self.uni, self.bi = (tuple(np.concatenate([_large(x[i]) for x in sorted(sums[g], key=lambda x: x[0])]) for i in (1, 2)) for g in (_UNI, _BI))

    def estimates(self, with_fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of each token's word, context and bigram."""
        g = self.grams
        uni, bi = (x[0] + x[1] if with_fold else x[0] for x in (self.uni, self.bi))
        return uni[g.uni_of], uni[g.context_of], bi[g.bi_of]


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, then one for each power of two."""
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _bins(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Eighths of a power of two below 1; -1 for zero."""
    with np.errstate(divide="ignore"):
        return np.where(n > 0, np.rint(-EIGHTHS * np.log2(np.maximum(n, 1) / np.maximum(of, 1))).astype(np.int64), -1)


def _histogram(tokens: int):
    def run(table: pa.Table) -> pa.Table:
        w, h, hw = _Answered(table).estimates(with_fold=False)
        cells = np.stack([bucket(h), _bins(hw, h), _bins(w, np.full(len(w), tokens))])
        cells, n = np.unique(cells, axis=1, return_counts=True)
        return pa.table([*(pa.array(c, pa.int64()) for c in cells), pa.array(n, pa.int64())], names=["bucket", "p2", "p1", "n"])

    return run


def expectation_maximisation(cells: np.ndarray, vocabulary: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket from rows of bucket, bins and counts."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)  # an unseen context says nothing
    if not len(cells):
        return weights
    b, n = cells[:, 0], cells[:, 3].astype(float)
    p = np.stack([*(np.where(cells[:, k] >= 0, 2.0 ** (-cells[:, k] / EIGHTHS), 0.0) for k in (1, 2)), np.full(len(cells), 1 / (vocabulary + 1))], axis=1)
    prior = weights.copy()
    change = np.inf
    while change > tolerance:  # each round raises the likelihood, which has one maximum
        share = weights[b] * p
        share *= (n / share.sum(1))[:, None]
        before, weights = weights, prior + np.stack([np.bincount(b, weights=share[:, k], minlength=BUCKETS) for k in range(3)], axis=1)
        weights /= weights.sum(1, keepdims=True)
        change = np.abs(weights - before).max()
    weights[:, 2] = np.maximum(weights[:, 2], LEAST_UNIFORM)
    return weights / weights.sum(1, keepdims=True)


def _scores(weights: np.ndarray, tokens: int, vocabulary: int):
    def run(table: pa.Table) -> pa.Table:
        a = _Answered(table)
        w, h, hw = a.estimates(with_fold=True)
        l2, l1, l0 = weights[bucket(h)].T
        p = l2 * hw / np.maximum(h, 1) + l1 * w / max(tokens, 1) + l0 / (vocabulary + 1)
        base = np.log10((w + 1) / (tokens + vocabulary + 1))
        at = a.grams.at
        total = lambda x: np.add.reduceat(x, at[:-1])
        held = a.docs["remainder"].to_numpy() == TEST
        cols = [pa.array(held), pa.array(a.grams.n), pa.array(total((w > 0).astype(np.int64))), pa.array(np.full(len(held), tokens)), pa.array(total(base)), pa.array(total(np.log10(p)))]
        return pa.table([a.docs["doc_id"], *cols], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = fan_out(docs.select("text"), 64 << 20)
    remainder = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % MODULUS, F.lit(-1)).cast("int")
    rows = docs.select("doc_id", remainder.alias("remainder"), F.coalesce("text", F.lit("")).alias("text"))
    asked = rows.mapInArrow(_requests(parts), _ROW).repartitionById(parts, F.col("part"))
    answered = written(asked.mapInArrow(_sum, _ROW), "counts")
    stats = np.zeros(4, dtype=np.int64)
    for r in answered.where(F.col("kind") == _STATS).select("a").toLocalIterator():
        stats += np.frombuffer(bytes(r["a"]), "<i8")
    rest, fold, vocabulary_rest, vocabulary = (int(x) for x in stats)
    blocks = answered.where(F.col("kind") != _STATS)
    cells = blocks.where("fold").groupBy("block").applyInArrow(_histogram(rest), "bucket long, p2 long, p1 long, n long")
    cells = cells.groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n")).collect()
    weights = expectation_maximisation(np.array(cells, dtype=np.int64).reshape(-1, 4), vocabulary_rest)
    return blocks.groupBy("block").applyInArrow(_scores(weights, rest + fold, vocabulary), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
