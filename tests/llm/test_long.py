"""One text above a slice for each operator that works in slices."""

import hashlib
import random

import public_tokenizers
from pyspark.sql import functions as F

from lattica.llm import jaccard, licenses, lm, packing, quality, warc
from lattica.llm import text as tx

from . import util


def long_text(seed=1):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(2, 9))) for _ in range(230_000))


def test_texts_above_a_slice(spark):
    t = long_text()
    assert len(t.encode()) > tx.SLICE_BYTES
    mit = "released under the mit license"
    rows = [(1, t), (2, t), (3, f"{t} one more"), (4, "a b c"), (5, f"{t} {mit}")]
    docs = spark.createDataFrame([(i, x, "en") for i, x in rows], "doc_id long, text string, lang string")

    found = {r["doc_id"]: r for r in quality.as_digest(quality.quality_rules(docs)).collect()}
    assert all((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == util.quality(dict(rows)[i]) for i, r in found.items())

    groups = {r["doc_id"]: (r["group_id"], r["n_links"]) for r in jaccard.near_duplicates(docs).collect()}
    assert groups == {1: (1, 3), 2: (1, 3), 3: (1, 3), 5: (1, 3), 4: (4, 0)}

    scan = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    assert scan[5]["base_labels"] == "mit" and scan[5]["first_word"] == 230_000 + 1 and scan[1]["n_base"] == 0 and scan[1]["n_words"] == 230_000

    scores = {r["doc_id"]: r for r in lm.lm_scores(docs).collect()}
    assert {i: r["n_tokens"] for i, r in scores.items()} == {i: len(util.words(x)) + 1 for i, x in rows} and scores[1]["score"] == scores[2]["score"]


def test_pieces_of_a_long_text_are_its_ids(spark):
    from tokenizers import Tokenizer

    t, path = long_text(2), public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(spark.createDataFrame([(1, t)], "doc_id long, text string"), path).orderBy("start").collect()
    ids = b"".join(bytes(p["ids"]) for p in pieces)
    want = Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids + [0]
    assert ids == b"".join(x.to_bytes(4, "little") for x in want) and {p["doc_tokens"] for p in pieces} == {len(want)}


def test_long_payloads_come_back(spark):
    t = long_text(3)
    pages = spark.createDataFrame([(1, "http://a/1", t), (2, "http://a/2", t), (3, "http://a/3", t[:99]), (4, None, None)], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in warc.as_digest(warc.archived(pages.repartition(2))).collect()}
    assert found[1]["payload_digest"] == hashlib.sha256(t.encode()).hexdigest() and found[1]["record_type"] == "response"
    assert (found[2]["record_type"], found[2]["refers_to"], found[2]["payload_bytes"]) == ("revisit", 1, len(t.encode()))
    assert pages.select(F.max(F.length("html"))).first()[0] > 1_000_000


def test_attempts_that_do_not_count_leave_nothing(spark, tmp_path, monkeypatch):
    """A second run into a folder keeps the first one's archives and removes its own stray ones."""
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"page {i} " * 40) for i in range(30)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    first = [r["path"] for r in warc.write_archives(pages, folder).collect()]
    monkeypatch.setattr(warc, "_run_id", lambda: "0123456789ab")
    (tmp_path / "warc" / "part-0123456789ab-000000-00000-77.warc.zst").write_bytes(b"by an attempt that was lost")
    second = [r["path"] for r in warc.write_archives(pages, folder).collect()]
    left = {x.name for x in (tmp_path / "warc").iterdir() if not x.name.endswith(".crc")}
    assert left == {p.rsplit("/", 1)[1] for p in first + second} and warc.read_archives(spark, second).count() == 30
