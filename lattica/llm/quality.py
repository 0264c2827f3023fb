"""Quality rules by distribution divergence.

A document's character-class histogram and its histogram of common words are compared with
references of its language by Jensen-Shannon distance. The references are sums over all
documents of each value of lang, however many there are. A language listed in COMMON is judged by
its sum; any other by its sum without the document itself, where that has MIN_WORDS words (the
same least length that a document needs for a verdict). Documents without such a reference are
compared with the one that fits them best among those of their script (mostly ASCII letters or
mostly others) of the listed languages and of those in more than a thousandth of the documents:
they are rejected if they are far from every one, and judged by the base rules alone if there is
none of their script.

References of languages in more than a thousandth of the documents reach every task (a thousand at
most, and those listed); documents of rarer languages are joined with theirs by lang.

Defined cases: a null or empty text has no words and fails; where no listed or frequent language has
documents, the sum of all documents stands for them; documents under MIN_WORDS words are judged by the base
rules alone (the histograms of so few words say nothing); a language of nothing but junk has junk for its
reference; repeated rows get the same answer each; other columns are carried along by
`quality_filter`, whatever their names, and ignored by `quality_rules`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm import text as tx
from lattica.session import ship, written

#: Frequent function words of each language (fixed values).
COMMON = {
    "en": "the of and to in is it that for was on are with as be at by this from or an but not they we his her had".split(),
    "es": "el la los las de que en un una por con del se lo para su al como es y no más pero sus le ya este sí".split(),
    "fr": "le la les de des du un une et que qui dans pour sur par est au aux en ce il elle pas avec son ne se plus".split(),
    "de": "der die das und ist in zu den von mit sich des auf für nicht ein eine einer dem im als auch es an werden aus er hat".split(),
}
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 100  # no divergence verdict below
MAX_CHARS = 0.28  # Jensen-Shannon distances (base 2, 0 to 1) above which a document is rejected
MAX_WORDS = 0.32
FREQUENT = 1000  # a language is frequent if more than one document in so many has it
HELD = 1000  # languages that a task sums up before it hands them on

_CLASSES = np.full(256, 9, dtype=np.int64)
for _k, _bytes in enumerate([range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), b" ", b"\n", b"\t\r\x0b\x0c", b".,;:!?'\"-()", SYMBOLS, range(0xC0, 0x100), None, range(0x80, 0xC0)]):
    if _bytes is not None:
        _CLASSES[list(_bytes)] = _k
N_CLASSES = 11  # the last, bytes inside a character, is left out


def _vocabulary() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all common words and their columns."""
    found = sorted({w for ws in COMMON.values() for w in ws})
    w = tx.words(pa.array([" ".join(found)]))
    h = w.hashes()
    order = np.argsort(h)
    return h[order], order


_HASHES, _COLUMN = _vocabulary()
N_COMMON = len(_HASHES) + 1  # and all other words


def histograms(w: tx.Words, lowered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts for each text: of character classes and of common words."""
    n = len(w.text_at) - 1
    of = np.repeat(np.arange(n), np.diff(w.text_at))
    chars = np.bincount(of * N_CLASSES + _CLASSES[w.data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)[:, :-1]
    i = np.minimum(np.searchsorted(_HASHES, lowered), len(_HASHES) - 1)
    column = np.where(_HASHES[i] == lowered, _COLUMN[i], N_COMMON - 1) if len(lowered) else i
    common = np.bincount(w.text_of_word() * N_COMMON + column, minlength=n * N_COMMON).reshape(n, N_COMMON)
    return chars, common


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of the rows of counts p from the rows of counts q; 0 where one is empty."""
    ps, qs = p.sum(1, keepdims=True), q.sum(1, keepdims=True)
    a, b = p / np.maximum(ps, 1), q / np.maximum(qs, 1)
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda x: np.where(x > 0, x * np.log2(x / m), 0.0).sum(1)
        d = np.sqrt(np.clip((kl(a) + kl(b)) / 2, 0, 1))
    return np.where((ps[:, 0] > 0) & (qs[:, 0] > 0), d, 0.0)


def _lowered(texts: pa.Array) -> np.ndarray:
    return tx.words(texts, lower=True).hashes()


_K = N_CLASSES - 1
_CELLS = _K + N_COMMON


def _words_of(hist: np.ndarray) -> np.ndarray:
    return hist[:, _K:].sum(1)


def _latin(hist: np.ndarray) -> np.ndarray:
    """Whether at least half of the letters are ASCII: the first bytes of other characters are class 8."""
    return hist[:, 0] + hist[:, 1] >= hist[:, 8]


def _apart(hist: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character and word distances, row by row."""
    return distance(hist[:, :_K], refs[:, :_K]), distance(hist[:, _K:], refs[:, _K:])


@dataclass
class References:
    """The histograms of languages, a row each; which row is whose; and which may stand for others."""

    row: dict[str, int]  # the listed ones first
    sums: np.ndarray
    near: np.ndarray

    def distances(self, langs: list, hist: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Character and word distances of each text; own holds the sums of the texts' languages if they have no row here."""
        at = np.array([self.row.get(x, -1) for x in langs], dtype=np.int64)
        listed = (at >= 0) & (at < len(COMMON))
        refs = np.where((at >= 0)[:, None], self.sums[at], 0) if own is None else own
        refs = np.where(listed[:, None], refs, np.maximum(refs - hist, 0))
        dc, dw = _apart(hist, refs)
        rest = np.flatnonzero(~listed & (_words_of(refs) < MIN_WORDS))
        best = np.full(len(rest), np.inf)
        dc[rest] = dw[rest] = 0.0
        for ref in self.near if len(rest) else ():
            c, w = _apart(hist[rest], np.broadcast_to(ref, hist[rest].shape))
            far = np.where(_latin(hist[rest]) == _latin(ref[None])[0], np.maximum(c / MAX_CHARS, w / MAX_WORDS), np.inf)
            nearer = far < best
            best[nearer], dc[rest[nearer]], dw[rest[nearer]] = far[nearer], c[nearer], w[nearer]
        return dc, dw


def _cells(held: dict) -> pa.RecordBatch:
    total = np.array(list(held.values()))
    k, c = np.nonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()).take(pa.array(k)), pa.array(c, pa.int32()), pa.array(total[k, c])], ["lang", "cell", "n"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of each language's histograms, and in the last cell its documents."""
    held: dict = {}
    for b in tx.slices(batches):
        both = np.hstack([*histograms(tx.words(b["text"]), _lowered(b["text"])), np.ones((b.num_rows, 1), dtype=np.int64)])
        names = b["lang"].to_pylist()
        found = {x: i for i, x in enumerate(dict.fromkeys(names))}
        total = np.zeros((len(found), both.shape[1]), dtype=np.int64)
        np.add.at(total, [found[x] for x in names], both)
        for x, i in found.items():
            held[x] = held.get(x, 0) + total[i]
        if len(held) > HELD:
            yield _cells(held)
            held = {}
    if held:
        yield _cells(held)


def references(docs: DataFrame) -> tuple[References, DataFrame | None]:
    """The references that every task gets, and those of rarer languages (lang, ref) if there are any.

    What reaches the driver is the listed languages, those in more than a thousandth of the documents
    (so a thousand at most), and the sum of all, with some 140 cells each."""
    ship(docs.sparkSession)
    cells = docs.select("text", "lang").mapInArrow(_sums, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    by_lang = F.map_from_entries(F.collect_list(F.struct("cell", "n")))  # bounded by the cells
    langs = written(cells.groupBy("lang").agg(by_lang.alias("cells"), F.max(F.when(F.col("cell") == _CELLS, F.col("n"))).alias("docs")), "languages")
    ref = F.transform(F.sequence(F.lit(0), F.lit(_CELLS - 1)), lambda i: F.coalesce(F.col("cells")[i], F.lit(0).cast("long")))
    total = langs.agg(F.sum("docs")).first()[0] or 0
    frequent = F.col("lang").isNotNull() & (F.col("lang").isin(*COMMON) | (F.col("docs") * FREQUENT > total))
    rarer = langs.where(F.col("lang").isNotNull() & ~frequent).select("lang", ref.alias("ref"))
    row, sums = {x: i for i, x in enumerate(COMMON)}, [np.zeros(_CELLS, dtype=np.int64) for _ in COMMON]
    for r in langs.where(frequent).select("lang", ref.alias("ref")).orderBy("lang").collect():
        h = np.array(r["ref"], dtype=np.int64)
        if r["lang"] in row:
            sums[row[r["lang"]]] = h
        else:
            row[r["lang"]] = len(sums)
            sums.append(h)
    near = [h for h in sums if h.any()]
    if not near:
        pool = np.zeros(_CELLS + 1, dtype=np.int64)
        for r in langs.select(F.explode("cells").alias("cell", "n")).groupBy("cell").agg(F.sum("n").alias("n")).collect():
            pool[r["cell"]] = r["n"]
        near = [pool[:-1]]
    return References(row, np.array(sums), np.array(near)), None if rarer.isEmpty() else rarer


_SYMBOL = tx.table(SYMBOLS)


def measures(texts: pa.Array, langs: list, refs: References, own: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """All columns of `quality_rules` for a slice."""
    w = tx.words(texts)
    total = len(w.s)
    chars_at = tx.per_text(~w.blank & ((w.data & 0xC0) != 0x80), w.text_at)
    h = w.hashes()
    tri, begin = tx.windows(h, w.word_at, 3)
    tri = tx.mix(tri ^ tx.mix(w.text_of_word()[begin].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(tri, kind="stable")
    same = np.zeros(len(tri), dtype=bool)
    if len(tri) > 1:
        eq = tri[order][1:] == tri[order][:-1]
        same[order[1:][eq]] = True
        same[order[:-1][eq]] = True
    cover = tx.covered(begin[same], 3, total)
    dup = np.zeros(len(texts), dtype=np.int64)
    raw, at = w.data.tobytes(), w.text_at
    for i in range(len(texts)):
        lines = [x for x in raw[at[i] : at[i + 1]].split(b"\n") if x and not x.isspace()]
        dup[i] = len(lines) - len(set(lines))
    n = w.counts
    rep = tx.per_text(cover, w.word_at)
    hist_c, hist_w = histograms(w, _lowered(texts))
    dc, dw = refs.distances(langs, np.hstack([hist_c, hist_w]), own)
    failed = (n < 50) | (100 * rep > 50 * n)
    odd = (n >= MIN_WORDS) & ((dc > MAX_CHARS) | (dw > MAX_WORDS))
    return {"n_words": n, "word_chars": chars_at, "n_symbols": tx.per_text(_SYMBOL[w.data], at), "n_dup_lines": dup, "n_repeat_words": rep, "char_distance": dc, "word_distance": dw, "base_failed": failed, "kept": ~failed & ~odd}


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, char_distance double, word_distance double, base_failed boolean, kept boolean"


def _judged(docs: DataFrame, kept: Column, schema: T.StructType, result) -> DataFrame:
    """What result makes of each batch's column kept and its measures; no shuffle but for rare languages."""
    ship(docs.sparkSession)
    refs, rarer = references(docs)
    rows = docs.select(kept.alias("kept"), F.col("text").alias("text"), F.col("lang").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches):
            own = np.array(b["ref"].to_pylist(), dtype=np.int64) if "ref" in b.schema.names else None
            yield result(b["kept"], measures(b["text"], b["lang"].to_pylist(), refs, own))

    if rarer is None:
        return rows.mapInArrow(run, schema)
    common = F.col("lang").isNull() | F.col("lang").isin(*refs.row)
    return rows.where(common).mapInArrow(run, schema).unionAll(rows.where(~common).join(rarer, "lang").select("kept", "text", "lang", "ref").mapInArrow(run, schema))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id and all measures and verdicts, a row for each row of docs (doc_id, text, lang)."""

    def result(ids: pa.Array, found: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *(pa.array(v) for v in found.values())], ["doc_id", *found])

    schema = T._parse_datatype_string(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")
    return _judged(docs, F.col("doc_id"), schema, result)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""

    def result(rows: pa.Array, found: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.filter(pa.array(found["kept"]))], ["kept"])

    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    schema = docs.select(whole.alias("kept")).schema
    return _judged(docs, whole, schema, result).select(*(F.col("kept").getField(c).alias(c) for c in docs.columns))


def as_digest(found: DataFrame) -> DataFrame:
    """The contract's columns and the two distances."""
    cols: list[Column] = [F.col(c) for c in "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept char_distance word_distance".split()]
    return found.select(*cols)
