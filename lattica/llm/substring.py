"""Substring deduplication by relative Lempel-Ziv parsing against every indexed block of the corpus.

Every document is reference for all later ones. It takes three steps:

1. Anchors. Of the seeds (runs of window // 2 words) of each window the one with the least hash is
   the window's anchor; equal windows have equal anchors, and neighbouring windows mostly share one.
   Blocks of documents deal their distinct anchors out by hash and learn which are repeated, in
   another block or at another place of their own. A window with another anchor occurs once.
2. Index. Only texts with repeated anchors go on. For each window with such an anchor, a block sends
   a 128-bit digest of its words (two independent 64-bit hashes, of words hashed independently too)
   and the first place that holds it. Equal digests of all blocks meet, and each place that isn't
   the earliest (smallest doc_id, then smallest start) is answered with its source, the earliest.
3. Parse. A block's documents are factored greedily from the left: a factor begins at the first
   window that has a source, and is extended by a word as long as the window that ends in this word
   has its source right behind the last one's; so all its words match the source's. At the factor's
   boundary, windows that begin inside it and end behind it are looked up too; one with another
   source begins the next factor, which overlaps. Factors are `window` words or longer, carry source
   and length, and are the duplicate spans.

Anchors only choose what is indexed, so equal hashes of theirs can't cause a wrong answer. Two
different windows would need equal 128-bit digests for one: about 4e-20 such pairs are expected at
5 * 10^9 windows (30 GB), 2e-13 at 10^13 (100 TB).

What moves: about 2 bytes a word for anchors, the texts that have repeated ones, 18 bytes for each
distinct repeated window of a block (copies inside a block are settled there, so a passage that all
documents share costs an entry a block, not one a document), 16 bytes for each match, and each text
with factors once more to be cut. Everything is dealt by hash of content or by block, into as many
parts as the input's size asks for, so no hot source, passage or group of copies meets in one task.

Defined cases: a null text has no words; an empty table gives an empty result; a null doc_id
counts as larger than every number; rows that repeat a doc_id and its text count as one document
and get the same answer each; rows that repeat a doc_id with other texts are one document whose
windows count by their start; extra columns are carried along, whatever their names. A text longer
than a slice or a block is worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm import bloom
from lattica.llm import text as tx
from lattica.session import fan_out, ship, written

WINDOW = 20
BLOCK_WORDS = 1 << 20  # places of a block, or four times as many words; with a text on top it stays under 2**32
PART_BYTES = 8 << 20  # of compressed input whose entries meet in one task
ANCHOR_BITS = 64  # of the anchors' hashes; fewer make more windows candidates, the answer stays
_ENTRIES, _BLOCK = 0, 1
_LAST = np.iinfo(np.int64).max
_PLACE = np.uint64((1 << 30) - 1)  # a slice is a megabyte or one text, and no text of 2**31 bytes has more words
_SECOND = np.uint64(0x6C62272E07BB0142)  # sets the second hash of a word apart from the first
_FACTOR = T.StructType().add("start", "long").add("length", "long").add("source", "long").add("source_start", "long")
_FACTORS = T.ArrayType(_FACTOR)
_ROW = "part int, kind int, block long, a binary, b binary, c binary"
_TYPES = [("part", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in "abc")]


def anchors(h: np.ndarray, word_at: np.ndarray, window: int, bits: int = ANCHOR_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all seeds, the word at which each window begins, and that of its anchor."""
    seed = max(1, window // 2)
    if len(h) < window:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    s = tx.mix(tx.run_hashes(h, seed)) & np.uint64(((1 << bits) - 1) << (64 - bits))
    # the least by 34 bits of the hash, then the leftmost; the place stands in the low bits
    least, have, span = (s & ~_PLACE) | np.arange(len(s), dtype=np.uint64), 1, window - seed + 1
    while have < span:  # minima over twice as many seeds each time
        more = min(have, span - have)
        least = np.minimum(least[: len(least) - more], least[more:])
        have += more
    room = np.repeat(word_at[1:], np.diff(word_at)) - np.arange(len(h)) >= window
    begin = np.flatnonzero(room[: len(least)])
    return s, begin, (least[begin] & _PLACE).astype(np.int64)


class _Docs:
    """The documents of a block: ids, text keys and where each one's words begin."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, at: np.ndarray) -> None:
        self.ids, self.keys, self.at = ids, keys, at

    def where(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The document of each place, and the word's number in it."""
        doc = np.searchsorted(self.at, place, side="right") - 1
        return doc, place - self.at[doc]


def _first_of_runs(*sorted_cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows differ from the one before, and the first row of each row's run."""
    new = np.ones(len(sorted_cols[0]), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in sorted_cols], axis=0)
    return new, np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, dtype=np.int64)


class _Block:
    """What a block's rows are made from: its documents, and hashed places in them."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.found: list[tuple[np.ndarray, ...]] = []
        self.words = self.size = 0

    def add(self, b: pa.RecordBatch, w: tx.Words, place: np.ndarray, *hashes: np.ndarray) -> None:
        self.ids.append(b["id"].to_numpy())
        self.keys.append(b["key"].to_numpy())
        self.counts.append(w.counts)
        self.found.append((place + self.words, *hashes))
        self.words += len(w.s)
        self.size += len(place)

    def whole(self) -> tuple[_Docs, tuple[np.ndarray, ...]]:
        at = np.concatenate([[0], np.cumsum(np.concatenate(self.counts))])
        found = tuple(np.concatenate(x) for x in zip(*self.found, strict=True))
        self.found.clear()
        return _Docs(np.concatenate(self.ids), np.concatenate(self.keys), at), found


def _blocks(batches: Iterator[pa.RecordBatch], size: int, add, rows) -> Iterator[pa.RecordBatch]:
    """The rows of all blocks of a task; a block is full at `size` places, or four times as many words."""

    def made() -> Iterator[tuple]:
        task, n, block = TaskContext.get().partitionId() << 32, 0, _Block()
        for b in tx.slices(batches):
            add(block, b)
            if max(block.words // 4, block.size) >= size:
                yield from rows(block, task + n)
                n, block = n + 1, _Block()
        if block.ids:
            yield from rows(block, task + n)

    return tx.batched(made(), _TYPES)


def _cuts(h: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """Part, begin and end of the ascending hashes."""
    part = (h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    cut = np.searchsorted(part, np.arange(parts + 1))
    return ((p, int(cut[p]), int(cut[p + 1])) for p in np.flatnonzero(np.diff(cut)).tolist())


def _anchored(parts: int, window: int, size: int, bits: int):
    """A block's distinct anchors, its documents, and the places of anchors that it repeats itself."""

    def add(block: _Block, b: pa.RecordBatch) -> None:
        w = tx.words(b["text"])
        s, _, place = anchors(w.hashes(), w.word_at, window, bits)
        place = place[np.flatnonzero(np.diff(place, prepend=-1))]
        block.add(b, w, place, s[place])

    def rows(block: _Block, name: int) -> Iterator[tuple]:
        d, (place, h) = block.whole()
        order = np.lexsort((place, h))
        h, place = h[order], place[order]
        new, _ = _first_of_runs(h)
        alone = new & np.append(new[1:], True)
        yield (int(name % parts), _BLOCK, name, d.ids.tobytes() + d.keys.tobytes(), d.at.astype("<u4").tobytes(), place[~alone].astype("<u4").tobytes())
        h, place = h[new], place[new]
        for p, i, j in _cuts(h, parts):
            yield (p, _ENTRIES, name, tx.packed(h[i:j]), place[i:j].astype("<u4").tobytes(), None)

    return lambda batches: _blocks(batches, size, add, rows)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All anchors of a part: the places, by block, of those that several blocks hold."""

    def rows() -> Iterator[tuple]:
        asked = []
        for b in batches:
            for row in zip(*(b[n].to_pylist() for n, _ in _TYPES), strict=True):
                if row[1] == _BLOCK:
                    yield row
                else:
                    asked.append((row[2], tx.unpacked(row[3]), row[4]))
        if not asked:
            return
        every = np.concatenate([a[1] for a in asked])
        order = np.argsort(every, kind="stable")
        same = every[order[1:]] == every[order[:-1]]
        again = np.zeros(len(every), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at = 0
        for block, keys, places in asked:
            mine = np.frombuffer(places, "<u4")[again[at : at + len(keys)]]
            at += len(keys)
            if len(mine):
                yield (0, _ENTRIES, block, mine.tobytes(), None, None)

    return tx.batched(rows(), _TYPES)


def _by_document(table: pa.Table) -> pa.Table:
    """All repeated anchors of a block, a row for each document that has some."""
    d, found = None, []
    for kind, x, y, z in zip(*(table[c].to_pylist() for c in ("kind", "a", "b", "c")), strict=True):
        if kind == _BLOCK:
            both = np.frombuffer(x, "<i8")
            d = _Docs(both[: len(both) // 2], both[len(both) // 2 :], np.frombuffer(y, "<u4").astype(np.int64))
            found.append(np.frombuffer(z, "<u4"))
        else:
            found.append(np.frombuffer(x, "<u4"))
    doc, word = d.where(np.unique(np.concatenate(found)).astype(np.int64))
    docs, begin = np.unique(doc, return_index=True)
    places = [x.astype("<u4").tobytes() for x in np.split(word, begin[1:])] if len(docs) else []
    tx.release()
    return pa.table([pa.array(d.ids[docs]), pa.array(d.keys[docs]), pa.array(places, pa.binary())], names=["id", "key", "places"])


def _index(parts: int, window: int, size: int, bits: int):
    """Digests and first places of a block's windows with repeated anchors, its documents, and the repetitions inside it."""

    def add(block: _Block, b: pa.RecordBatch) -> None:
        w = tx.words(b["text"])
        h = w.hashes()
        _, begin, anchor = anchors(h, w.word_at, window, bits)
        wanted = np.zeros(len(h) + 1, dtype=bool)
        for at, places in zip(w.word_at[:-1].tolist(), b["places"].to_pylist(), strict=True):
            if places is not None:
                wanted[at + np.frombuffer(places, "<u4").astype(np.int64)] = True
        begin = begin[wanted[anchor]]
        if len(begin):
            x = tx.mix(tx.run_hashes(h, window)[begin])
            y = tx.mix(tx.run_hashes(tx.hash_spans(w.data, w.s, w.e, _SECOND), window)[begin] ^ _SECOND)
        else:
            x = y = np.zeros(0, dtype=np.uint64)
        block.add(b, w, begin, x, y)

    def rows(block: _Block, name: int) -> Iterator[tuple]:
        d, (place, x, y) = block.whole()
        doc, start = d.where(place)
        order = np.lexsort((start, d.ids[doc], y, x))
        x, y, place, doc, start = x[order], y[order], place[order], doc[order], start[order]
        _, lead = _first_of_runs(x, y)
        later = (d.ids[doc] != d.ids[doc[lead]]) | (start != start[lead])
        own = np.stack([place[later], place[lead[later]]]).astype("<u4")
        yield (int(name % parts), _BLOCK, name, d.ids.tobytes() + d.keys.tobytes(), d.at.astype("<u4").tobytes(), own.tobytes())
        x, y, place = x[~later], y[~later], place[~later]  # repeated rows of a document have equal places, so all of them stay
        for p, i, j in _cuts(x, parts):
            used = np.unique(d.where(place[i:j])[0])
            begins = np.concatenate([d.at[used], place[i:j]]).astype("<u4")
            yield (p, _ENTRIES, name, tx.packed(x[i:j]), y[i:j].tobytes(), d.ids[used].tobytes() + begins.tobytes())

    return lambda batches: _blocks(batches, size, add, rows)


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All entries of a part of the digests: the places that have a source, by block."""

    def rows() -> Iterator[tuple]:
        xs, ys, ids, starts, places, blocks, names = [], [], [], [], [], [], []
        for b in batches:
            for part, kind, block, a, y, c in zip(*(b[n].to_pylist() for n, _ in _TYPES), strict=True):
                if kind == _BLOCK:
                    yield (part, _BLOCK, block, a, y, c)
                    continue
                h = tx.unpacked(a)
                docs = (len(c) - 4 * len(h)) // 12
                used, both = np.frombuffer(c, "<i8", docs), np.frombuffer(c, "<u4", offset=8 * docs)
                at, place = both[:docs], both[docs:]
                doc = np.searchsorted(at, place, side="right") - 1
                xs.append(h)
                ys.append(np.frombuffer(y, "<u8"))
                ids.append(used[doc])
                starts.append(place - at[doc])
                places.append(place)
                blocks.append(np.full(len(h), len(names), dtype=np.int32))
                names.append(block)
        if not xs:
            return
        x, y, i, s, p, b = (np.concatenate(c) for c in (xs, ys, ids, starts, places, blocks))
        xs.clear(), ys.clear(), ids.clear(), starts.clear(), places.clear(), blocks.clear()
        order = np.argsort(x, kind="stable")
        same = x[order[1:]] == x[order[:-1]]
        again = np.zeros(len(x), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        order = order[again]
        order = order[np.lexsort((s[order], i[order], y[order], x[order]))]
        if not len(order):
            return
        x, y, i, s, p, b = (c[order] for c in (x, y, i, s, p, b))
        _, lead = _first_of_runs(x, y)
        later = (i != i[lead]) | (s != s[lead])
        p, b, source, source_start = p[later], b[later], i[lead[later]], s[lead[later]]
        order = np.lexsort((p, b))
        p, b, source, source_start = p[order], b[order], source[order], source_start[order]
        for block, k, n in zip(*np.unique(b, return_index=True, return_counts=True), strict=True):
            c = slice(k, k + n)
            yield (0, _ENTRIES, names[block], p[c].astype("<u4").tobytes(), source[c].tobytes(), source_start[c].astype("<u4").tobytes())

    return tx.batched(rows(), _TYPES)


def greedy_factors(place: np.ndarray, doc: np.ndarray, source: np.ndarray, source_start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The factors of a block, given its windows that have a source in order: which window each begins with, and its length.

    A factor goes on where the next window begins a word later and its source does too."""
    if not len(place):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.ones(len(place), dtype=bool)
    new[1:] = (np.diff(place) != 1) | (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (np.diff(source_start) != 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(place)) - 1
    return begin, place[last] - place[begin] + window


def _parse(window: int):
    def run(table: pa.Table) -> pa.Table:
        """All matches of a block, and the documents they are in."""
        d = own = None
        places, sources, starts = [], [], []
        for kind, x, y, z in zip(*(table[c].to_pylist() for c in ("kind", "a", "b", "c")), strict=True):
            if kind == _BLOCK:
                both = np.frombuffer(x, "<i8")
                d = _Docs(both[: len(both) // 2], both[len(both) // 2 :], np.frombuffer(y, "<u4").astype(np.int64))
                own = np.frombuffer(z, "<u4").reshape(2, -1).astype(np.int64)
            else:
                places.append(np.frombuffer(x, "<u4").astype(np.int64))
                sources.append(np.frombuffer(y, "<i8"))
                starts.append(np.frombuffer(z, "<u4").astype(np.int64))
        place, source, start = (np.concatenate([*x, np.zeros(0, dtype=np.int64)]) for x in (places, sources, starts))
        order = np.argsort(place, kind="stable")
        place, source, start = place[order], source[order], start[order]
        if own.shape[1]:  # a place inside the block has the source of the first one, or that one itself
            lead_doc, lead_start = d.where(own[1])
            own_source, own_start = d.ids[lead_doc], lead_start
            if len(place):
                i = np.minimum(np.searchsorted(place, own[1]), len(place) - 1)
                known = place[i] == own[1]
                own_source, own_start = np.where(known, source[i], own_source), np.where(known, start[i], own_start)
            place, source, start = np.concatenate([place, own[0]]), np.concatenate([source, own_source]), np.concatenate([start, own_start])
            order = np.argsort(place, kind="stable")
            place, source, start = place[order], source[order], start[order]
        doc, word = d.where(place)
        begin, length = greedy_factors(place, doc, source, start, window)
        cut = np.flatnonzero(np.diff(doc[begin], prepend=-1) != 0)
        rows = zip(*(np.split(x, cut[1:]) for x in (word[begin], length, source[begin], start[begin])), strict=True) if len(begin) else ()
        packed = [np.stack(r).astype("<i8").tobytes() for r in rows]
        docs = doc[begin][cut]
        tx.release()
        return pa.table([pa.array(d.ids[docs]), pa.array(d.keys[docs]), pa.array(packed, pa.binary())], names=["id", "key", "factors"])

    return run


def duplicate_factors(docs: DataFrame, window: int = WINDOW, block: int = BLOCK_WORDS, bits: int = ANCHOR_BITS) -> DataFrame:
    """id, key, factors: for each text with duplicate spans, its factors.

    id is doc_id with null as the largest number, key the text's hash; factors packs the word at
    which each begins, the lengths, the sources' ids and the words there, as little-endian 64-bit
    numbers, all of a kind one after the other."""
    ship(docs.sparkSession)
    parts = fan_out(docs.select("text"), PART_BYTES)
    rows = _keyed(docs)
    asked = rows.mapInArrow(_anchored(parts, window, block, bits), _ROW).repartitionById(parts, F.col("part"))
    answered = asked.mapInArrow(_repeated, _ROW).repartition(parts, "block")
    places = answered.groupBy("block").applyInArrow(_by_document, "id long, key long, places binary").repartition(parts, "id", "key")
    places = written(places.groupBy("id", "key").agg(F.min("places").alias("places")), "anchors")  # repeated rows have equal ones
    index = _having(rows, places, parts).mapInArrow(_index(parts, window, block, bits), _ROW).repartitionById(parts, F.col("part"))
    matched = index.mapInArrow(_match, _ROW).repartition(parts, "block")
    found = matched.groupBy("block").applyInArrow(_parse(window), "id long, key long, factors binary").repartition(parts, "id", "key")
    return found.groupBy("id", "key").agg(F.min("factors").alias("factors"))


def _having(rows: DataFrame, of: DataFrame, parts: int) -> DataFrame:
    """rows that `of` has (by id and key), with its columns, and a few others with nulls; only these are shuffled."""
    tested = bloom.tested(rows, "key", bloom.build(of, "key"), "maybe").where("maybe").drop("maybe")
    return tested.repartition(parts, "id", "key").join(of.repartition(parts, "id", "key"), ["id", "key"], "left")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in tx.slices(batches):
        w, n = tx.words(b["text"]), b.num_rows
        packed = b["factors"].to_pylist()
        texts, lost, factors = [], np.zeros(n, dtype=np.int64), []
        whole = w.data.tobytes()
        for i in range(n):
            lo, hi = w.text_at[i], w.text_at[i + 1]
            if packed[i] is None:
                texts.append(whole[lo:hi])
                factors.append([])
                continue
            first, last = w.word_at[i], w.word_at[i + 1]
            start, length, source, source_start = np.frombuffer(packed[i], "<i8").reshape(4, -1)
            d = np.zeros(last - first + 1, dtype=np.int32)
            np.add.at(d, start, 1)
            np.add.at(d, start + length, -1)
            gone = np.cumsum(d[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            kept, at = [], lo
            for a, z in zip(edge[::2], edge[1::2], strict=True):  # from a removed run's first word to the next kept word
                kept.append(whole[at : w.s[first + a]])
                at = w.s[first + z] if first + z < last else hi
            kept.append(whole[at:hi])
            texts.append(b"".join(kept))
            lost[i] = gone.sum()
            factors.append([dict(zip(_FACTOR.names, (int(x) for x in f), strict=True)) | ({"source": None} if f[2] == _LAST else {}) for f in zip(start, length, source, source_start, strict=True)])
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in _FACTOR.names]))
        yield pa.RecordBatch.from_arrays([b["row"], pa.array(w.counts), pa.array(lost), pa.array(factors, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["row", "n_words", "n_removed", "factors", "kept_text"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, block: int = BLOCK_WORDS, bits: int = ANCHOR_BITS) -> DataFrame:
    """row (all columns of docs but text), n_words, n_removed, factors and kept_text of every row.

    factors holds start, length, source (a doc_id) and source_start in words; factors may overlap.
    kept_text is the text without the words of the factors and the blanks after them."""
    parts = fan_out(docs.select("text"), PART_BYTES)
    factors = written(duplicate_factors(docs, window, block, bits), "factors")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    tested = bloom.tested(rows, "key", bloom.build(factors, "key"), "maybe")  # only texts with factors are shuffled
    hits = tested.where("maybe").repartition(parts, "id", "key").join(factors.repartition(parts, "id", "key"), ["id", "key"], "left").select("row", "text", "factors")
    joined = tested.where("not maybe").select("row", "text", F.lit(None).cast("binary").alias("factors")).unionByName(hits)
    schema = joined.select("row").schema.add("n_words", "long").add("n_removed", "long").add("factors", _FACTORS).add("kept_text", "string")
    return joined.mapInArrow(_cut, schema)


def as_digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    one_space = F.trim(F.regexp_replace("kept_text", "[ \\t-\\r]+", " "))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(one_space, 256).alias("kept_sha256"))


def substring_stage(docs: DataFrame) -> DataFrame:
    """docs with the duplicate spans cut from text and n_chars counted anew; rows left without a word go."""
    found = substring_dedup(docs)
    out = [(F.col("kept_text") if c == "text" else F.char_length("kept_text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return found.where("n_words > n_removed").select(*out)
