"""Byte-pair encoding by backtracking over longest matches, and decoding from an offset table.

A piece of text is encoded from left to right: an Aho-Corasick automaton has found the longest
token at every place, and a token is taken if it is compatible with the one before it, which means
that merging the two tokens' text in rank order would give just these two. If it isn't, the next
shorter token at that place is tried; if none is left, the place is marked dead and the token
before it is shortened. A sequence whose neighbours are all compatible is the only one that the
merges can end in, so the ids are exactly those of applying merges one by one, in linear time.

Normalising and splitting into pieces is the tokenizer file's own, by the `tokenizers` library; no
piece is encoded by it. Chunks between blanks and pieces are kept with their ids in a worker.

Decoding gathers byte ranges of one array that holds every token's text; tokens are joined as a
file without decoder says, by single spaces.

Defined cases: a null text counts as empty and has no ids; an empty table gives an empty result;
repeated rows are encoded each; null keys are carried along; strings of special tokens in a text
become their ids; texts of any length are worked on in parts of about a megabyte, cut at blanks
where the tokenizer drops these; other columns are ignored, whatever their names. A null in the
ids decodes to null.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm import text as tx
from lattica.session import ship

_END = "\x01"  # stands behind the last character of a piece, where the model marks word ends
_GAP = "\x00"  # between pieces; neither is a character of a byte-level alphabet
_PART = 1 << 20  # characters worked on at a time
_LEARN = 1 << 15  # characters that are split into pieces in one call
_CACHE = 400_000  # chunks, pieces and pairs that a worker keeps
_TAKEN = "__lattica_taken"
_CACHED = 64  # longer chunks and pieces are as good as unique
_COMMON = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")
_BYTE_LEVEL = {c: chr(c).encode().decode("latin-1").translate({b: 0x100 + n for n, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}) for c in [*range(0xDF, 0xF7), *range(0xF8, 0x100)]}
_BLANKS_DROPPED = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _drops_blanks(spec: dict) -> bool:
    """Whether texts can be cut at spaces and line ends: no step joins what stands around them."""
    normal = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
    steps = normal.get("normalizers", [normal])
    known = all(s["type"] in ("NFC", "Lowercase") or s == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} for s in steps)
    pre = spec["pre_tokenizer"] or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    return known and first == {"type": "Split", "pattern": {"Regex": _BLANKS_DROPPED}, "behavior": "Removed", "invert": True}


class Merges:
    """The merges of a BPE model: longest matches, shorter prefixes and compatible pairs.

    Tokens are numbered here by rank: first the single characters, then each merge's result."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str | None) -> None:
        import ahocorasick

        self.suffix = suffix or ""
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        made = {a + b for a, b in pairs}
        if len(made) != len(pairs):
            raise ValueError("two merges make the same token")
        plain = [t for t in vocab if t not in made and len(t) == 1]
        ending = [t for t in vocab if suffix and t not in made and len(t) == 1 + len(suffix) and t.endswith(suffix)]
        number = {t: i for i, t in enumerate(plain + ending)}
        self.text = plain + [t[0] + _END for t in ending]
        self.first_merge = len(self.text)
        self.left, self.right = list(range(self.first_merge)), list(range(self.first_merge))
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in pairs:
            n = len(self.text)
            x, y = number[a], number[b]
            number[a + b] = n
            self.text.append(self.text[x] + self.text[y])
            self.left.append(x)
            self.right.append(y)
            self.merged[x, y] = n
        self.ids_of = tuple(vocab[t] for t in number)
        self._known: dict[int, bool] = {}
        whole = [i < self.first_merge or self._apart(self.left[i], self.right[i], i) for i in range(len(self.text))]
        for i in range(self.first_merge, len(whole)):  # a token that its own text's merges never end in is never met
            whole[i] = whole[i] and whole[self.left[i]] and whole[self.right[i]]
        at = {self.text[i]: i for i, ok in enumerate(whole) if ok}
        self.length = [len(t) for t in self.text]
        self.shorter = [next((at[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in at), -1) for t in self.text]
        self.automaton = ahocorasick.Automaton()
        for t, i in at.items():
            self.automaton.add_word(t[::-1], i)
        self.automaton.make_automaton()

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether merges below limit leave the border between two tokens uncrossed.

        Undoes the later of the two tokens' merges step by step; a pair that meets at the border
        may not merge before the merge that was undone last (or, to the right of it, at the same rank)."""
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < limit:
                return False
            if a > b and a >= self.first_merge:
                limit, a = a, self.right[a]
            elif b >= self.first_merge:
                limit, b = b + 1, self.left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        """The pair table, filled as pairs are met."""
        ok = self._known.get(a << 32 | b)
        if ok is None:
            if len(self._known) > _CACHE:
                self._known.clear()
            ok = self._known[a << 32 | b] = self._apart(a, b, len(self.text) + 1)
        return ok

    def encode(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of each piece (characters of the byte-level alphabet)."""
        end = _END if self.suffix else ""
        joined = _GAP.join(p + end for p in pieces) + _GAP
        found = list(self.automaton.iter(joined[::-1]))  # read backwards, matches end where tokens begin, the longest of a place first
        found.reverse()
        longest = list(map(dict(found).get, range(len(joined) - 1, -1, -1), repeat(-1)))
        out, at = [], 0
        for p in pieces:
            stop = at + len(p) + len(end)
            token = longest[at]
            out.append(self.ids_of[token : token + 1] if p and at + self.length[token] == stop else self._walk(longest, at, stop))
            at = stop + 1
        return out

    def _walk(self, longest: list[int], at: int, stop: int) -> tuple[int, ...]:
        length, known = self.length, self._known
        taken: list[int] = []
        dead: set[int] = set()
        last = -1
        while at < stop:
            token = longest[at]
            while True:
                while token >= 0:
                    then = at + length[token]
                    if then not in dead:
                        if last < 0:
                            break
                        ok = known.get(last << 32 | token)
                        if self.compatible(last, token) if ok is None else ok:
                            break
                    token = self.shorter[token]
                if token >= 0:
                    break
                dead.add(at)
                if last < 0:
                    raise ValueError("a piece holds characters that no token covers")
                at -= length[last]
                token = self.shorter[last]
                taken.pop()
                last = taken[-1] if taken else -1
            taken.append(token)
            last, at = token, then
        return tuple(map(self.ids_of.__getitem__, taken))


class Coder:
    """Encodes and decodes by a tokenizer file with a BPE model."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or spec.get("decoder"):
            raise ValueError(f"{path} is no plain BPE model")
        self.library = Tokenizer.from_file(path)
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix"))
        self.cut = _drops_blanks(spec)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that look around them")
        self.added = added
        self.special = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        every = {i: t for t, i in (model["vocab"] | added).items()}
        texts = [every.get(i, "").encode() + b" " if i in every else b"" for i in range(max(every) + 1)]
        self.bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.pieces: dict[str, tuple[int, ...]] = {"": ()}
        self.clear()

    def clear(self) -> None:
        self.chunks: dict[str, int] = {}
        self.ids, self.n = np.zeros(1 << 16, dtype=np.uint32), 0
        self.at, self.len, self.used = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64), 0

    def _normal(self, chunk: str) -> str:
        if self.cut and chunk.isascii() and chunk.isprintable():
            return chunk.lower()
        return self.library.normalizer.normalize_str(chunk) if self.library.normalizer else chunk

    def _split(self, parts: list[str]) -> list[list[str]]:
        """The pieces of each normalised part; one call does many parts where blanks are dropped."""
        if not self.cut:
            return [[p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(s)] for s in parts]
        out: list[list[str]] = [[] for _ in parts]
        ends, k = np.cumsum([len(s) + 1 for s in parts]).tolist(), 0
        for piece, (start, _) in self.library.pre_tokenizer.pre_tokenize_str("\n".join(parts)):
            while start >= ends[k]:
                k += 1
            out[k].append(piece)
        return out

    def _common(self, chunk: str) -> tuple[str, str] | None:
        """The pieces of a chunk of common letters and perhaps one mark, which the general way would find too."""
        m = _COMMON.fullmatch(chunk)
        if m is None:
            return None
        letters, mark = m.groups()
        letters = letters.lower()
        return letters if letters.isascii() else letters.translate(_BYTE_LEVEL), mark

    def _general(self, chunks: list[str]) -> list[list[str | int]]:
        """The pieces of any chunks, and the ids of special tokens between them."""
        parts: list[list[str | int]] = []
        for c in chunks:
            found, last = [], 0
            for m in self.special.finditer(c) if self.special else ():
                found += [self._normal(c[last : m.start()]), self.added[m.group()]]
                last = m.end()
            parts.append([*found, self._normal(c[last:])])
        flat = [p for ps in parts for p in ps if isinstance(p, str)]
        split: list[list[str]] = []
        i = 0
        while i < len(flat):
            j, size = i, 0
            while j < len(flat) and (size < _LEARN or j == i):
                size += len(flat[j]) + 1
                j += 1
            split += self._split(flat[i:j])
            i = j
        following = iter(split)
        return [list(chain.from_iterable([p] if isinstance(p, int) else next(following) for p in ps)) for ps in parts]

    def _fresh(self, chunks: list[str]) -> list:
        """The ids of chunks that aren't known yet."""
        split: list = list(map(self._common, chunks)) if self.cut else [None] * len(chunks)
        rest = [i for i, x in enumerate(split) if x is None]
        for i, x in zip(rest, self._general([chunks[i] for i in rest]), strict=True):
            split[i] = x
        pieces = self.pieces
        new = list({p for ps in split for p in ps if p not in pieces and isinstance(p, str)})
        pieces.update(zip(new, self.merges.encode(new), strict=True))
        out = [pieces[ps[0]] + pieces[ps[1]] if len(ps) == 2 and type(ps[0]) is str and type(ps[1]) is str else list(chain.from_iterable([p] if isinstance(p, int) else pieces[p] for p in ps)) for ps in split]
        for p in new:
            if len(p) > _CACHED:
                del pieces[p]
        return out

    def _learn(self, chunks: list[str]) -> None:
        found = self._fresh(chunks)
        lens = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        total = int(lens.sum())
        if self.n + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), dtype=np.uint32)])
        if self.used + len(lens) > len(self.at):
            self.at, self.len = (np.concatenate([x, np.zeros(max(len(x), len(lens)), dtype=np.int64)]) for x in (self.at, self.len))
        self.ids[self.n : self.n + total] = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=total)
        self.at[self.used : self.used + len(lens)] = self.n + np.cumsum(lens) - lens
        self.len[self.used : self.used + len(lens)] = lens
        self.chunks.update(zip(chunks, range(self.used, self.used + len(lens)), strict=True))
        self.n, self.used = self.n + total, self.used + len(lens)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin (and the end)."""
        if len(self.chunks) > _CACHE or self.n > 8 * _CACHE:
            self.clear()
        if len(self.pieces) > _CACHE:
            self.pieces = {"": ()}
        split = [t.replace("\n", " ").split(" ") if self.cut else [t] for t in texts]
        flat = list(chain.from_iterable(split))
        places = np.fromiter(map(self.chunks.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        unseen = np.flatnonzero(places < 0).tolist()
        if unseen:
            missing = list({flat[i] for i in unseen})
            self._learn(missing)
            places[unseen] = [self.chunks[flat[i]] for i in unseen]
            for c in missing:
                if len(c) > _CACHED:
                    del self.chunks[c]
        lens = self.len[places]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.at[places] - ends + lens, lens) + np.arange(total)]
        last = np.cumsum(np.fromiter(map(len, split), dtype=np.int64, count=len(split)))
        return ids, np.concatenate([[0], np.concatenate([[0], ends])[last]])

    def encode_long(self, text: str) -> np.ndarray:
        """The ids of one text, worked on in parts that end at a space where blanks are dropped."""
        out, at = [], 0
        while at < len(text):
            to = text.find(" ", at + _PART) if self.cut else -1
            to = len(text) if to < 0 else to
            out.append(self.encode([text[at:to]])[0])
            at = to
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' text joined by spaces, from the offset table."""
        if not len(ids):
            return b""
        ids = ids[ids < len(self.offsets) - 1].astype(np.int64)
        begin = self.offsets[ids]
        lens = self.offsets[ids + 1] - begin
        ends = np.cumsum(lens)
        return self.bytes[np.repeat(begin - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)][:-1].tobytes()


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One coder for a worker's life."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def _encoder(path: str, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for b in tx.slices(batches, _TAKEN, 1 << 19):
            texts = ["" if t is None else t for t in b[_TAKEN].to_pylist()]
            if len(texts) == 1:
                ids = code.encode_long(texts[0])
                at = np.array([0, len(ids)])
            else:
                ids, at = code.encode(texts)
            data = ids.astype("<u4").tobytes()
            found = pa.array([data[4 * lo : 4 * hi] for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), pa.array(np.diff(at), pa.int64()), found], [*keys, "n_tokens", "ids"])

    return run


def _decoder(path: str, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for b in tx.slices(batches, _TAKEN, 1 << 20):
            texts = [None if x is None else code.decode(np.frombuffer(x, dtype="<u4")) for x in b[_TAKEN].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), pa.array(texts, pa.binary()).cast(pa.string())], [*keys, "decoded"])

    return run


def _column(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _mapped(rows: DataFrame, keys: list[str], taken: str, run, made: dict[str, str]) -> DataFrame:
    """keys and the columns made by run, which sees the keys as k0, k1, ... whatever their names."""
    ship(rows.sparkSession)
    names = [f"k{i}" for i in range(len(keys))]
    kinds = [f"{n} {rows.schema[k].dataType.simpleString()}" for n, k in zip(names, keys, strict=True)]
    plain = rows.select(*(_column(k).alias(n) for k, n in zip(keys, names, strict=True)), _column(taken).alias(_TAKEN))
    return plain.mapInArrow(run(names), ", ".join([*kinds, *(f"{n} {t}" for n, t in made.items())])).toDF(*keys, *made)


def encoded(rows: DataFrame, keys: list[str], tokenizer: str, text: str = "text") -> DataFrame:
    """keys, n_tokens and ids (little-endian unsigned 32-bit) of every row's text."""
    return _mapped(rows, keys, text, partial(_encoder, tokenizer), {"n_tokens": "long", "ids": "binary"})


def decoded(rows: DataFrame, keys: list[str], tokenizer: str, ids: str = "ids") -> DataFrame:
    """keys and the decoded text of every row's ids; keys may be any columns of the rows."""
    return _mapped(rows, keys, ids, partial(_decoder, tokenizer), {"decoded": "string"})


def as_digest(rows: DataFrame) -> DataFrame:
    """The contract's columns."""
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
