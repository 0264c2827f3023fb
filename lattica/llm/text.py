"""Vectorised words and hashes over Arrow string columns (bounded slices, no per-word Python)."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # text bytes worked on at a time; one longer text is a slice of its own
LONG_WORD = 128  # longer words are hashed one by one

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def table(blank) -> np.ndarray:
    """256 flags: which bytes separate words."""
    out = np.zeros(256, dtype=bool)
    out[list(blank)] = True
    return out


BLANK = table([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche."""
    x = x ^ (x >> np.uint64(30))
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


def hash_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: np.uint64 = np.uint64(0)) -> np.ndarray:
    """64-bit hashes of data[s:e], the same in every process; those of two seeds are independent."""
    n = e - s
    h = mix(n.astype(np.uint64) * _M1 ^ seed)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    long = n > LONG_WORD
    todo = np.arange(len(s)) if not long.any() else np.flatnonzero(~long)
    at = 0
    while len(todo):
        left = np.minimum(n[todo] - at, 8)
        h[todo] = mix((h[todo] ^ (eight[s[todo] + at] & _KEEP[left])) * _M1)
        at += 8
        todo = todo[n[todo] > at]
    for i in np.flatnonzero(long):
        h[i] = int.from_bytes(hashlib.blake2b(data[s[i] : e[i]].tobytes(), digest_size=8, key=int(seed).to_bytes(8, "little")).digest(), "little")
    return h


@dataclass
class Words:
    """The words of the texts of a slice."""

    data: np.ndarray  # bytes of all texts, one after the other
    text_at: np.ndarray  # where each text begins, and the end
    s: np.ndarray  # where each word begins
    e: np.ndarray  # and ends
    word_at: np.ndarray  # the first word of each text, and the number of words
    blank: np.ndarray  # flags of bytes outside words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.text_at) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.s, self.e)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array, blank: np.ndarray = BLANK, lower: bool = False) -> Words:
    """All words of a string column: runs of bytes that aren't flagged in blank."""
    data, at = raw(texts)
    if lower:
        data = LOWER[data]
    out = blank[data]
    first, last = ~out, ~out
    if len(data):
        first[1:] &= out[:-1]
        last[:-1] &= out[1:]
        begins = at[:-1][at[:-1] < at[1:]]
        first[begins] = ~out[begins]
        ends = at[1:][at[:-1] < at[1:]] - 1
        last[ends] = ~out[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, at, s, e, np.searchsorted(s, at), out)


def release() -> None:
    """Give memory that nothing uses back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about `limit` bytes of text at most, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = raw(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j
        del batch
        release()


def windows(h: np.ndarray, word_at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one text, and the word at which each begins."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    room = np.zeros(len(h), dtype=bool)
    counts = np.diff(word_at)
    room_at = np.repeat(word_at[1:], counts) - np.arange(len(h))
    room = room_at >= n
    w = run_hashes(h, n)
    begin = np.flatnonzero(room[: len(w)])
    return mix(w[begin]), begin


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One number for each n neighbours of h, not yet mixed."""
    w = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        w *= _M1
        w += h[k : len(h) - n + 1 + k]
    return w


def packed(h: np.ndarray) -> bytes:
    """Ascending hashes as differences of 6 bytes where these suffice."""
    d = np.diff(h, prepend=h[:1] * np.uint64(0))
    if len(d) > 1 and int(d[1:].max()) < 1 << 48:
        return b"6" + int(h[0]).to_bytes(8, "little") + np.ascontiguousarray(d[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    return b"8" + h.astype("<u8").tobytes()


def unpacked(x: bytes) -> np.ndarray:
    if x[:1] == b"8":
        return np.frombuffer(x, "<u8", offset=1)
    d = np.zeros(((len(x) - 9) // 6, 8), dtype=np.uint8)
    d[:, :6] = np.frombuffer(x, np.uint8, offset=9).reshape(-1, 6)
    return np.concatenate([np.frombuffer(x, "<u8", 1, 1), d.view("<u8").ravel()]).cumsum(dtype=np.uint64)


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i+1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def covered(begin: np.ndarray, n: int, total: int) -> np.ndarray:
    """Flags of the words in any of the windows of n words that start at begin."""
    d = np.zeros(total + 1, dtype=np.int32)
    np.add.at(d, begin, 1) if len(begin) and (np.diff(begin) <= 0).any() else d.__setitem__(begin, 1)
    ends = np.minimum(begin + n, total)
    d -= np.bincount(ends, minlength=total + 1)[: total + 1].astype(np.int32)
    return np.cumsum(d[:total]) > 0


def batched(rows: Iterator[tuple], types: list[tuple[str, pa.DataType]], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, bytes)) + 64
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), types, strict=True)], [n for n, _ in types])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), types, strict=True)], [n for n, _ in types])
    held.clear()
    release()
