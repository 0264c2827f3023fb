"""Cost-balanced packing of tokenised documents into sequences.

A document is tokenised and cut into whole sequences; what remains of it is packed. A piece of l
tokens costs LINEAR * l + QUADRATIC * l**2 (feed-forward work, and attention inside the piece).
The remainders of a block are taken in descending order, each to the lowest-cost sequence with
remaining capacity for all of it. If none has that, it fills the lowest-cost sequence that has any
capacity, and what is left of it is taken again in its place in the order. A block has exactly as many full sequences as its tokens
fill, and the tokens left over get sequences whose capacities are powers of two, which need no
padding; so nothing is padded.

Packing is local to blocks of a task's input: no shuffle, and memory bounded by the block.
Sequence ids hold the task's number in their high bits.

Defined cases: a null text counts as empty and yields the end id alone; an empty table gives an
empty result; repeated rows are packed each; a null doc_id is carried along; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import gc
import heapq
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import text as tx
from lattica.session import ship

LENGTH = 1024
END = 0
LINEAR, QUADRATIC = 1.0, 1 / 2048
BLOCK = 8192  # remainders packed together

_CUT = re.compile(r"(?<=\S)(?= \S)")
_SPACE = "\u0120"  # a space byte in a byte-level vocabulary
_JOIN = 1000
_CACHED_CHUNK = 64
_CACHE_SIZE = 800_000


def _uneven(text: str) -> bool:
    """Whether there are other blanks than single spaces and line ends between two words."""
    found, blanks = text.split(), text.count(" ") + text.count("\n")
    return len(found) != blanks + 1 or len("".join(found)) != len(text) - blanks or "\0" in text


def _cuttable(tokenizer) -> bool:
    """Whether a tokenizer is byte-level BPE without normaliser, splits by itself at blanks and puts none before a text."""
    from tokenizers import models, pre_tokenizers

    return tokenizer.normalizer is None and isinstance(tokenizer.model, models.BPE) and isinstance(tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and tokenizer.pre_tokenizer.use_regex and not tokenizer.pre_tokenizer.add_prefix_space


class Encoder:
    """Token ids by `tokenizers`, with the ids of earlier chunks kept.

    Byte-level pre-tokenisation never joins what stands before a single space, or on either side
    of a single line end, between two non-blank characters, so a text's ids are those of its
    chunks, one after the other. With any other tokenizer a text is one chunk."""

    def __init__(self, path: str, end: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.whole = not _cuttable(self.tokenizer)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith(_SPACE)]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.n = np.array([self.end], dtype=np.uint32), 1
        self.at, self.len, self.used = np.zeros(1024, dtype=np.int32), np.ones(1024, dtype=np.int32), 1

    def _joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and lengths of chunks that begin with their only space: encoded as one text, where an id whose bytes begin with a space begins a chunk."""
        ids = np.asarray(self.tokenizer.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        begins = np.flatnonzero(self.spaced[ids])
        if len(begins) != len(chunks) or begins[0]:
            return None
        return ids, np.diff(np.append(begins, len(ids)))

    def _learn(self, chunks: list[str], odd: set[str]) -> list[int]:
        """Places of the chunks, which are put in the same order; odd: those of texts with runs of blanks."""
        plain = [c for c in chunks if c[:1] == " " and c not in odd]
        rest = set(chunks).difference(plain)
        parts = []
        for k in range(0, len(plain), _JOIN):
            if (got := self._joined(plain[k : k + _JOIN])) is None:
                rest.update(plain[k : k + _JOIN])
            else:
                parts.append((plain[k : k + _JOIN], *got))
        if rest:
            single = list(rest)
            found = [e.ids for e in self.tokenizer.encode_batch_fast(single, add_special_tokens=False)]
            parts.append((single, np.concatenate([np.asarray(x, dtype=np.uint32) for x in found]), np.fromiter(map(len, found), dtype=np.int64, count=len(found))))
        chunks[:] = [c for part in parts for c in part[0]]
        new, lens = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        total = int(lens.sum())
        while self.n + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), 1 << 16), dtype=np.uint32)])
        while self.used + len(lens) > len(self.at):
            self.at, self.len = (np.concatenate([x, np.zeros(len(x), dtype=np.int32)]) for x in (self.at, self.len))
        self.ids[self.n : self.n + total] = new
        self.at[self.used : self.used + len(lens)] = self.n + np.cumsum(lens) - lens
        self.len[self.used : self.used + len(lens)] = lens
        out = range(self.used, self.used + len(lens))
        self.n, self.used = self.n + total, self.used + len(lens)
        return list(out)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and where each text's begin (and the end)."""
        if len(self.known) > _CACHE_SIZE or self.n > 8 * _CACHE_SIZE:
            self.clear()
        odd = [self.whole or _uneven(t) for t in texts]
        split = [[t] if t else [] for t in texts] if self.whole else [_CUT.split(t) if x else t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") for t, x in zip(texts, odd, strict=True)]
        flat = list(chain.from_iterable(split))
        per_text = np.fromiter(map(len, split), dtype=np.int64, count=len(split)) + 1
        places = np.fromiter(map(self.known.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        unseen = np.flatnonzero(places < 0).tolist()
        if unseen:
            missing = list({flat[i] for i in unseen})
            found = self._learn(missing, set(chain.from_iterable(c for c, x in zip(split, odd, strict=True) if x)))
            self.known.update(zip(missing, found, strict=True))
            places[unseen] = [self.known[flat[i]] for i in unseen]
            for c in missing:  # long chunks are as good as unique
                if len(c) > _CACHED_CHUNK:
                    del self.known[c]
        picks = np.zeros(per_text.sum(), dtype=np.int64)  # 0 is the end id's place
        body = np.ones(len(picks), dtype=bool)
        body[np.cumsum(per_text) - 1] = False
        picks[body] = places
        lens = self.len[picks]
        ends = np.cumsum(lens, dtype=np.int32)  # a batch of texts has fewer than 2**31 tokens
        ids = self.ids[np.repeat(self.at[picks] - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        return ids, np.concatenate([[0], ends[np.cumsum(per_text) - 1].astype(np.int64)]) if len(split) else np.zeros(1, dtype=np.int64)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    """One encoder for a worker's life; later tasks find the chunks of earlier ones."""
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


def assign(lengths: list[int], capacity: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (item, start, length, sequence, offset), and the capacities of the sequences."""
    total = sum(lengths)
    rooms = [capacity] * (total // capacity)
    left = total % capacity
    rooms += [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    free, cost = rooms.copy(), [0.0] * len(rooms)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences that have less room than is asked for now
    for k, room in enumerate(rooms):
        by_room[room].append(k)
    opened: list[tuple[float, int]] = []  # those that have as much or more
    every = [(0.0, k) for k in range(len(rooms))]  # all of them, at former costs too
    level = capacity + 1
    items = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(items)
    out = []
    while items:  # what is left of a cut piece queues again, so lengths never rise
        n, item, start = heapq.heappop(items)
        n = -n
        while level > n:
            level -= 1
            for k in by_room[level]:
                if free[k] == level:
                    heapq.heappush(opened, (cost[k], k))
            by_room[level].clear()
        c, k = heapq.heappop(opened or every)
        while c != cost[k] or not free[k]:
            c, k = heapq.heappop(every)
        taken = min(n, free[k])
        out.append((item, start, taken, k, rooms[k] - free[k]))
        free[k] -= taken
        cost[k] = c + linear * taken + quadratic * taken * taken
        if free[k]:
            heapq.heappush(every, (cost[k], k))
            if free[k] >= level:
                heapq.heappush(opened, (cost[k], k))
            else:
                by_room[free[k]].append(k)
        if taken < n:
            heapq.heappush(items, (taken - n, item, start + taken))
    return out, rooms


PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, ids binary"
_NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "ids"]


def _packer(path: str, capacity: int, end: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and the chunk table is large to walk
        try:
            yield from packed(batches)
        finally:
            gc.enable()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, used = encoder(path, end), TaskContext.get().partitionId() << 40, 0
        rows: list[tuple] = []
        rest: list[tuple] = []  # doc_id, start, doc_tokens, ids

        def flush() -> pa.RecordBatch:
            types = [id_type, *[pa.int64()] * 6, pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _NAMES)
            rows.clear()
            return out

        def pack() -> None:
            nonlocal used
            pieces, rooms = assign([len(x[3]) for x in rest], capacity)
            for item, start, n, k, offset in pieces:
                doc, before, total, ids = rest[item]
                rows.append((doc, before + start, n, total, task + used + k, offset, rooms[k], ids[start : start + n].tobytes()))
            used += len(rooms)
            rest.clear()

        for b in tx.slices(batches, limit=1 << 20):
            ids, at = encode(["" if t is None else t for t in b["text"].to_pylist()])
            for doc, lo, hi in zip(b["doc_id"].to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                total = hi - lo
                whole = total - total % capacity
                for start in range(0, whole, capacity):
                    rows.append((doc, start, capacity, total, task + used, 0, capacity, ids[lo + start : lo + start + capacity].astype("<u4").tobytes()))
                    used += 1
                if whole < total:
                    rest.append((doc, whole, total, ids[lo + whole : hi].astype("<u4")))
            if len(rest) >= BLOCK:
                pack()
            if len(rows) >= 512:
                yield flush()
        if rest:
            pack()
        if rows:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = LENGTH, end: int = END) -> DataFrame:
    """The pieces of all documents with their token ids (little-endian unsigned 32-bit)."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return docs.select("doc_id", "text").mapInArrow(_packer(tokenizer, capacity, end, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, {PIECES}")


def as_digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns and the tokens of the piece's sequence."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")
