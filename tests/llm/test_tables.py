"""WARC archives, URL filter, top-k search and segmentations on the other tables."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from lattica.llm import bloom, segment, topk, urlfilter, warc


def rows_of(df):
    return [r.asDict() for r in df.collect()]


BIG = "<p>" + "é" * 60 + "</p>"
PAGES = [(5, "http://a.example.org/x", BIG), (3, "http://b.example.org/y", BIG), (4, None, BIG), (3, "http://b.example.org/y", BIG), (6, "bad\r\nurl", "short"), (7, "u", "short"), (8, "u", None), (9, "u", ""), (None, "u", BIG), (10, "u", "x" * 300_000)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "z", "y") for r in rows], "page_id long, url string, html string, digest string, payload string").repartition(2)


def test_warc_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    manifest = rows_of(warc.write_archives(pages(spark), folder, limit=2000))
    assert sum(m["records"] for m in manifest) == len(PAGES) and len(manifest) > 2
    found = rows_of(warc.read_archives(spark, [m["path"] for m in manifest]))
    want = Counter()
    for i, _, html in PAGES:
        b = (html or "").encode()
        refers = 3 if html == BIG and i != 3 else None
        want[i, len(b), hashlib.sha256(b).hexdigest(), "response" if refers is None else "revisit", refers] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == want
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in found)
    assert next(r for r in found if r["page_id"] == 10)["payload"] == b"x" * 300_000


def test_warc_archive_format():
    import zstandard

    recs = [warc.record(i, f"http://h/{i}", (f"hello number {i} " * 30).encode(), "0", None) for i in range(400)]
    data = warc.archive(recs)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    n = int.from_bytes(data[4:8], "little")
    d = zstandard.ZstdCompressionDict(data[8 : 8 + n])
    assert d.dict_id() != 0 and list(warc.records(data)) == recs
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in recs)
    assert len(data) - n < plain
    assert list(warc.records(warc.archive(recs[:1]))) == recs[:1]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.records(data[:-3]))


def test_warc_empty_table(spark):
    assert warc.archived(pages(spark, [])).count() == 0


URLS = [None, "no scheme", "http://www.Example.org/es/a?x", "https://example.org/en/12#t", "http://sub.example.org/en/2", "http://org", "http://a.com/fr/x", "http://a.com/de/x", "http://com/de/", "http://xcom/de/", "http://b.net/p/", "https://www.b.net/p?q=1", "http://b.net/P", "x://y://z/p", "http://c.net", "http://example.org", "http://É.net/ä"]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits) if fits else None


def test_url_filter_matches_brute_force(spark):
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate([*URLS, URLS[10]])], "page_id long, url string, host string")
    listed = spark.createDataFrame([("https://b.net/p",), ("https://b.net/p",), (None,), ("nothing",), ("http://a.com/fr/x",)], "url string")
    found = {r["page_id"]: r for r in rows_of(urlfilter.url_filter(df, listed))}
    assert len(found) == len(URLS) + 1
    for i, u in enumerate([*URLS, URLS[10]]):
        host, path, rule = judge(u)
        on_list = rule is None and host.removeprefix("www.") + path.rstrip("/") == "b.net/p"
        want = (host, path, rule[2] if rule else None, rule[3] if rule else "block" if on_list else "allow")
        assert tuple(found[i][c] for c in ("host", "path", "rule", "verdict")) == want, u
    nothing = urlfilter.url_filter(df, listed.limit(0))
    assert {r["verdict"] for r in rows_of(nothing) if r["rule"] is None} == {"allow"}
    assert urlfilter.url_filter(df.limit(0), listed).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) as key")
    f = bloom.build(keys, "key")
    assert bloom.tested(keys, "key", f, "maybe").where("not maybe").count() == 0
    others = spark.range(20_000).selectExpr("concat('o', id) as key")
    assert bloom.tested(others, "key", f, "maybe").where("maybe").count() < 400


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<float>, v string")


def whole(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(64.0 * np.float32(x)) for x in v]


@pytest.mark.parametrize("k", [3, 20])
def test_top_k_matches_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    r = random.Random(2)
    rows = [(i, [round(r.uniform(-1, 1), 1) if r.random() < 0.6 else 0.0 for _ in range(5)]) for i in range(180)]
    rows += [(200, None), (220, [1.0, None]), (240, [float("nan")]), (260, [float("inf"), 1.0]), (None, [1.0] * 5), (280, []), (300, [0.5, 0.5]), (301, rows[0][1]), (302, rows[0][1]), rows[20], rows[21]]
    ok = [(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None]
    found = rows_of(topk.top_k(vectors(spark, rows).drop("v").select("vec_id", topk.whole("embedding").alias("v")), (lambda c: c % 20 == 0)(__import__("pyspark.sql.functions", fromlist=["col"]).col("vec_id")), k))
    want = set()
    for q, a in dict(sorted(ok)).items():
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)[:k]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {(f["query_id"], f["rank"], f["vec_id"], f["score"]) for f in found} == want and len(found) == len(want)
    assert any(len({f["vec_id"] for f in found if f["query_id"] == q}) < k for q, _ in ok)  # both rows of a repeated vec_id are ranked


def test_top_k_empty(spark):
    from pyspark.sql import functions as F

    df = vectors(spark, []).drop("v").select("vec_id", topk.whole("embedding").alias("v"))
    assert topk.top_k(df, F.col("vec_id") % 20 == 0).count() == 0


TURNS = [(1, 0, "Hello  world, this is it"), (1, 1, None), (1, 2, ""), (2, 0, "a\nb\t Ⅷ 😀 x"), (None, 0, "the"), (3, None, " lead and trail "), (4, 0, "hello " * 400), (1, 0, "Hello  world, this is it")]


def unpacked(ids):
    return tuple(np.frombuffer(bytes(ids), "<u4").tolist())


def test_segmentations_round_trip_and_are_distinct(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(*t, "z", "y") for t in TURNS], "conv_id long, turn long, text string, key string, ids string")
    found = rows_of(segment.decoded(segment.sample_segmentations(df, ["conv_id", "turn"], path), path))
    again = rows_of(segment.sample_segmentations(df.repartition(3), ["conv_id", "turn"], path))
    key = lambda r: (str(r["conv_id"]), str(r["turn"]), r["sample"], unpacked(r["ids"]), r["log_prob"], r["perturbed"], r["inclusion"])
    assert sorted(map(key, found)) == sorted(map(key, again))
    by = {}
    for r in found:
        by.setdefault((r["conv_id"], r["turn"]), []).append(r)
    for c, t, text in set(TURNS):
        rs = by[c, t]
        assert all(r["decoded"] == (text or "") == segment.decode(path, unpacked(r["ids"])) for r in rs)
        if not text:
            assert [r["ids"] for r in rs] == [b""] and rs[0]["inclusion"] == 1
        else:
            once = {unpacked(r["ids"]) for r in rs}
            assert len(once) == len({r["sample"] for r in rs}) and all(0 <= r["inclusion"] <= 1 and r["log_prob"] <= 1e-9 for r in rs)
            assert [r["perturbed"] for r in sorted(rs, key=lambda r: r["sample"])] == sorted((r["perturbed"] for r in rs), reverse=True)
    assert segment.sample_segmentations(df.limit(0), ["conv_id", "turn"], path).count() == 0


def test_piece_counts_are_those_of_the_plain_encoding(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("piece_bpe_32k.model")
    v = segment.pieces(path)
    want = np.ones(v.size)
    for _, _, t in TURNS:
        for i in v.model.encode(t or ""):
            want[i] += 1
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, text string")
    assert np.allclose(segment.piece_probabilities(df, path), np.log(want / want.sum()))


def test_segmentation_queries_read_documents_and_turns_and_decode(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    from lattica.llm import queries

    spark.createDataFrame([(i, text) for i, (_, _, text) in enumerate(TURNS)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    found = rows_of(queries.op7_gumbel_top_k(spark, str(tmp_path)))
    assert {r["doc_id"] for r in found} == set(range(len(TURNS)))
    assert all(r["decoded_sha256"] == sha(TURNS[r["doc_id"]][2]) for r in found)
    texts = {(c, t): x for c, t, x in TURNS}
    turns = rows_of(queries.op7_gumbel_top_k_turns(spark, str(tmp_path)))
    assert {(r["conv_id"], r["turn"]) for r in turns} == set(texts)
    assert all(r["decoded_sha256"] == sha(texts[r["conv_id"], r["turn"]]) for r in turns)


def segmentations(v, log_p, text):
    """All segmentations of a text and their probabilities, by plain enumeration."""
    whole = segment.MARK + text.replace(" ", segment.MARK)

    def rest(i):
        if i == len(whole):
            yield (), 0.0
        ways = [((v.place[whole[i:j]],), j) for j in range(i + 1, len(whole) + 1) if whole[i:j] in v.place]
        if i < len(whole) and whole[i] not in v.place:
            ways.append((tuple(v.byte[b] for b in whole[i].encode()), i + 1))
        for ids, j in ways:
            for more, p in rest(j):
                yield ids + more, p + sum(log_p[x] for x in ids)

    found = dict(rest(0))
    total = math.log(math.fsum(map(math.exp, found.values())))
    return {ids: p - total for ids, p in found.items()}


def drawn(texts, keys, v, log_p, k):
    for which, s, ids, at, log_prob, perturbed, inclusion in segment.sampled(texts, keys, v, log_p, k):
        for r, t in enumerate(which.tolist()):
            yield t, s, tuple(ids[at[r] : at[r + 1]].tolist()), log_prob[r], perturbed[r], inclusion[r]


def test_segmentations_match_plain_enumeration():
    P = pytest.importorskip("public_tokenizers")
    v = segment.pieces(P.path("piece_bpe_32k.model"))
    log_p = np.random.default_rng(4).uniform(-9, -1, v.size)
    texts = ["the", "ab cd", "\u2167x", "a\nb", "x", " a", "\U0001f600 a"]
    for k in (1, 3, 400):
        found: dict = {}
        for t, s, ids, p, g, q in drawn(texts, segment.tx.mix(np.arange(len(texts), dtype=np.uint64)), v, log_p, k):
            found.setdefault(t, []).append((s, ids, p, g, q))
        for t, text in enumerate(texts):
            want, rows = segmentations(v, log_p, text), found[t]
            assert len({r[1] for r in rows}) == len(rows) == min(k, len(want)) and [r[0] for r in rows] == list(range(len(rows)))
            assert all(math.isclose(want[r[1]], r[2], abs_tol=1e-9) for r in rows)
            scores = [r[3] for r in rows]
            assert scores == sorted(scores, reverse=True)
            if k >= len(want):
                assert all(r[4] == 1 for r in rows)
            else:  # the score left out follows from any inclusion, and is the same for all
                left = {round(r[2] - math.log(-math.log1p(-r[4])), 5) for r in rows if 1e-9 < r[4] < 1 - 1e-9}
                assert len(left) <= 1 and all(x <= scores[-1] + 1e-5 for x in left)


def test_segmentations_follow_their_distribution():
    P = pytest.importorskip("public_tokenizers")
    v = segment.pieces(P.path("piece_bpe_32k.model"))
    log_p = np.full(v.size, math.log(0.2))
    every = {ids: math.exp(p) for ids, p in segmentations(v, log_p, "the").items()}
    n = 20_000
    order: dict = {}
    weight = Counter()
    for t, s, ids, _, _, q in drawn(["the"] * n, segment.tx.mix(np.arange(n, dtype=np.uint64)), v, log_p, 2):
        order.setdefault(t, []).append(ids)
        weight[ids] += 1 / q
    pairs = Counter(map(tuple, order.values()))
    for a, p in every.items():
        assert p < 0.1 or abs(weight[a] / n - 1) < 0.05
        for b, q in every.items():
            if a != b:
                w = p * q / (1 - p)  # without replacement
                assert abs(pairs[a, b] / n - w) < 5 * math.sqrt(w / n) + 1e-4


def test_lattices_are_kept_and_shared_by_chunks_that_end_alike(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    v = segment.pieces(P.path("piece_bpe_32k.model"))
    log_p = np.random.default_rng(5).uniform(-9, -1, v.size)
    slices = [["other mother", "", None], ["smother \u2581 other\n\nx\u2167\U0001f600 ", "other\u2167"], ["", ""], ["other mother", "a\x00b", "mother\n smother"]]

    def found(graph):
        return [[(w.tolist(), s, ids.tolist(), at.tolist(), *(x.tolist() for x in rest)) for w, s, ids, at, *rest in segment.sampled(texts, segment.tx.mix(np.arange(len(texts), dtype=np.uint64)), v, log_p, 4, graph() if callable(graph) else graph)] for texts in slices]

    alone = found(lambda: segment.Graph(v, log_p))
    kept = segment.Graph(v, log_p)
    assert found(kept) == alone
    held = kept.nodes, kept.edges
    assert found(kept) == alone and (kept.nodes, kept.edges) == held  # nothing is built again
    one = segment.Graph(v, log_p)
    chunks = ["\u2581other", "\u2581mother", "\u2581smother"]
    one.roots(np.array([len(c) for c in chunks]), np.array([ord(c) for c in "".join(chunks)]))
    assert one.nodes == 1 + len({c[i:] for c in chunks for i in range(len(c))})
    monkeypatch.setattr(segment, "_NODES", 16)  # cleared and grown all the time
    assert found(segment.Graph(v, log_p)) == alone


def test_long_texts_are_segmented_whole():
    P = pytest.importorskip("public_tokenizers")
    path = P.path("piece_bpe_32k.model")
    v = segment.pieces(path)
    texts = ["ab" * 700, "one two " * 20_000, "x"]
    rows = list(drawn(texts, np.arange(3, dtype=np.uint64), v, np.full(v.size, -8.0), 3))
    assert all(segment.decode(path, ids) == texts[t] for t, _, ids, *_ in rows) and len(rows) == 8
