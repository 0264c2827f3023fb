"""Quality rules, near duplicates, substrings, packing, LM scores and license scans on documents."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lattica.llm import jaccard, licenses, lm, packing, quality, substring
from lattica.llm import text as tx

from . import util


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_quality_matches_brute_force(spark):
    found = rows_of(quality.as_digest(quality.quality_rules(util.docs(spark))))
    want = Counter((i, *util.quality(t)) for i, t in util.texts())
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in found) == want
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_quality_filter_keeps_columns_and_decides_as_the_rules(spark):
    docs = util.docs(spark)
    kept = quality.quality_filter(docs)
    assert kept.schema == docs.schema
    want = Counter(r["doc_id"] for r in rows_of(quality.quality_rules(docs)) if r["kept"])
    assert Counter(r["doc_id"] for r in rows_of(kept)) == want


def test_quality_distance():
    p, q = np.array([[1, 1, 0], [5, 0, 0], [0, 0, 0]]), np.array([[1, 1, 0], [0, 3, 0], [1, 1, 1]])
    assert quality.distance(p, q).tolist() == [0.0, 1.0, 0.0]


def test_quality_rejects_symbol_junk_and_keeps_prose(spark):
    prose = [(i, " ".join(["the", "of", f"w{i}", "and", "to", f"x{i}", "in", "that", f"y{i}"][j % 9] + str((i * j) % 7) * (j % 2) for j in range(150))) for i in range(40)]
    junk = [(100, " ".join(f"{'#$%&'[j % 4] * 3}{j}{'*|' * 3}" for j in range(150)))]
    kept = {r["doc_id"] for r in rows_of(quality.quality_filter(util.docs(spark, prose + junk)))}
    assert 100 not in kept


def test_quality_judges_every_language(spark):
    r = np.random.default_rng(5)
    say = lambda words, n: " ".join(str(x) + str(i % 7) * (i % 2) for i, x in enumerate(r.choice(words, n)))
    italian, german = "il la che non per una sono mi ho lo ma ti cosa le con".split(), quality.COMMON["de"]
    junk = lambda k: " ".join(f"{'#$%&'[j % 4] * 3}{j + k}{'*|' * 3}" for j in range(150))
    upper = " ".join(f"QXZ{'ABCDEFG'[j % 7] * 4}{'HIJKLMNO'[j % 8] * 3}{chr(65 + j % 26)}{chr(65 + j // 26)}" for j in range(200))
    rows = [(i, say(quality.COMMON["en"], 200), "en") for i in range(40)] + [(100 + i, say(german, 200), "de") for i in range(40)] + [(200 + i, say(italian, 300), "it") for i in range(40)]
    rows += [(300, say(quality.COMMON["en"], 200), None), (301, say(german, 200), "de-AT"), (302, say(italian, 200), "it-CH")]
    rows += [(400 + i, t, lang) for i, (t, lang) in enumerate([(t, lang) for t in (junk(1), junk(2), upper) for lang in (None, "it", "en-US", "en")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {x["doc_id"]: x for x in rows_of(quality.quality_rules(df))}
    assert not any(x["base_failed"] for x in found.values())
    assert {i for i, x in found.items() if not x["kept"]} == set(range(400, 412))


def test_quality_without_any_language_is_judged_by_all(spark):
    r = np.random.default_rng(6)
    rows = [(i, " ".join(str(x) + str(j % 7) * (j % 2) for j, x in enumerate(r.choice(quality.COMMON["en"], 200)))) for i in range(40)]
    rows += [(100, " ".join(f"{'#$%&'[j % 4] * 3}{j}{'*|' * 3}" for j in range(150)))]
    df = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, lang string")
    assert {x["doc_id"] for x in rows_of(quality.quality_rules(df)) if not x["kept"]} == {100}


def spans_of(factors):
    return {i for f in factors for i in range(f["start"], f["start"] + f["length"])}


def test_substring_matches_brute_force(spark):
    want = util.substring(util.texts())
    found = rows_of(substring.substring_dedup(util.docs(spark)).selectExpr("row.doc_id", "n_words", "n_removed", "kept_text", "factors"))
    assert len(found) == len(util.texts())
    wanted = Counter((i, *want[i, t]) for i, t in util.texts())
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], " ".join(util.words(r["kept_text"]))) for r in found) == wanted
    assert all(len(spans_of(r["factors"])) == r["n_removed"] for r in found)


def test_substring_factors_match_their_sources(spark):
    rows = [(i, t) for i, t in util.texts() if i not in (None, 1, 4)] + [(1, util.texts()[0][1]), (4, util.texts()[3][1])]
    texts = {i: util.words(t) for i, t in rows}
    found = {r["doc_id"]: r["factors"] for r in rows_of(substring.substring_dedup(util.docs(spark, rows)).selectExpr("row.doc_id", "factors"))}
    for i, factors in found.items():
        for f in factors:
            s, n, j, a = f["start"], f["length"], f["source"], f["source_start"]
            assert n >= 20 and (j, a) < (i, s) and texts[i][s : s + n] == texts[j][a : a + n]
        assert [f["start"] for f in factors] == sorted(f["start"] for f in factors)
    whole = found[2]
    assert [(f["start"], f["length"], f["source"], f["source_start"]) for f in whole] == [(0, 200, 1, 0)]


def test_substring_factors_are_greedy_and_checked_at_boundaries():
    place, doc = np.array([3, 4, 5, 6, 40]), np.zeros(5, dtype=np.int64)
    source, start = np.array([1, 1, 2, 2, 2]), np.array([7, 8, 0, 1, 35])
    begin, length = substring.greedy_factors(place, doc, source, start, 20)
    assert begin.tolist() == [0, 2, 4] and length.tolist() == [21, 21, 20]


@pytest.mark.parametrize("block, bits, window", [(50, 64, 20), (50, 3, 20), (substring.BLOCK_WORDS, 1, 20), (200, 64, 3), (30, 2, 1)])
def test_substring_in_small_blocks_and_with_weak_hashes(spark, block, bits, window):
    rows = util.texts(3)
    found = rows_of(substring.substring_dedup(util.docs(spark, rows).coalesce(1), window, block, bits).selectExpr("row.doc_id", "n_words", "n_removed", "kept_text"))
    brute = util.substring(rows, window)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], " ".join(util.words(r["kept_text"]))) for r in found) == Counter((i, *brute[i, t]) for i, t in rows)


def test_substring_of_texts_above_a_slice(spark):
    r = np.random.default_rng(9)
    long = " ".join(map(str, r.integers(0, 10**6, 300_000).tolist()))
    assert len(long) > tx.SLICE_BYTES
    w = long.split()
    rows = [(1, " ".join(w[200_000:200_050])), (2, long), (3, " ".join(["x", *w[5:299_000]])), (4, " ".join(w[:30]) + " y")]
    found = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in rows_of(substring.as_digest(substring.substring_dedup(util.docs(spark, rows))))}
    assert found == {1: (50, 0), 2: (300_000, 50), 3: (298_996, 298_995), 4: (31, 30)}


def test_substring_anchors_of_equal_windows_are_equal():
    r = np.random.default_rng(1)
    h = tx.mix(r.integers(0, 4, 3000).astype(np.uint64))
    s, begin, anchor = substring.anchors(h, np.array([0, 1000, 1000, 3000]), 8)
    known: dict = {}
    for b, a in zip(begin.tolist(), anchor.tolist(), strict=True):
        assert b <= a <= b + 4
        assert known.setdefault(h[b : b + 8].tobytes(), (a - b, int(s[a]))) == (a - b, int(s[a]))
    assert len(begin) == 993 + 1993


def test_substring_stage_keeps_columns(spark):
    docs = util.docs(spark)
    out = substring.substring_stage(docs)
    assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert all(r["n_chars"] == len(r["text"]) and util.words(r["text"]) for r in rows_of(out))


def test_near_duplicates_match_brute_force(spark):
    found = rows_of(jaccard.near_duplicates(util.docs(spark)))
    assert Counter((r["doc_id"], r["n_links"]) for r in found if r["doc_id"] is not None) == Counter(util.links(util.texts()))
    by = {r["doc_id"]: r for r in found}
    assert by[2]["class_id"] == 1 and by[11]["class_id"] == 10 and by[31]["group_id"] == by[1]["group_id"] == 1
    assert by[8]["group_id"] == 8 and by[8]["n_links"] == 0
    assert sum(r["doc_id"] is None for r in found) == 3 and all(r["n_links"] == 0 for r in found if r["doc_id"] is None)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "NODE_BLOCK", 3)
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 4)
    found = rows_of(jaccard.near_duplicates(util.docs(spark)))
    assert Counter((r["doc_id"], r["n_links"]) for r in found if r["doc_id"] is not None) == Counter(util.links(util.texts()))


def test_near_duplicates_of_many_sizes_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 3)
    r = np.random.default_rng(8)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[: int(n)])) for i, n in enumerate(r.integers(60, 400, 60))]
    found = rows_of(jaccard.near_duplicates(util.docs(spark, rows)))
    assert Counter((x["doc_id"], x["n_links"]) for x in found) == Counter(util.links(rows))


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    docs = util.docs(spark)
    kept = jaccard.near_duplicate_stage(docs)
    assert kept.schema.names == docs.schema.names
    ids = Counter(r["doc_id"] for r in rows_of(kept))
    assert ids[1] == ids[4] == 1 and not {2, 3, 11, *range(20, 32)} & set(ids) and ids[None] == 3


def test_near_duplicate_stage_judges_texts_of_a_repeated_id_each(spark):
    r = np.random.default_rng(2)
    a, b, c = (" ".join(map(str, r.integers(0, 10**6, 60))) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (9, c), (9, c + " x"), (11, None), (11, ""), (11, "")]
    kept = Counter((x["doc_id"], x["text"]) for x in rows_of(jaccard.near_duplicate_stage(util.docs(spark, rows))))
    nine = [k for k in kept if k[0] == 9]
    assert len(nine) == 1 and nine[0][1] in (c, c + " x")
    del kept[nine[0]]
    assert kept == Counter({(3, a): 1, (5, b): 1, (11, None): 1, (11, ""): 1})


def test_shortest_prefix_reaches_recall():
    d = jaccard.shortest_prefix()
    assert d < jaccard.DEPTH and 1 - (1 - 0.8**d) ** jaccard.TREES >= jaccard.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** jaccard.TREES


def test_prefixes_are_shortened_by_what_they_find():
    r = np.random.default_rng(3)
    d, m = jaccard.shortest_prefix(), jaccard.TREES * jaccard.DEPTH
    base = r.integers(0, 1 << 16, m)

    def near(s):  # a signature that agrees by s, whole in the first tree's shortest prefix
        out = np.where(r.random(m) < s, base, r.integers(0, 1 << 16, m))
        out[:d] = base[:d]
        return out

    def depths(sims, shared):
        sig = np.stack([base, *map(near, sims)])
        for row, n in zip(sig[1:], shared, strict=True):
            row[d : d + n] = base[d : d + n]
            if d + n < jaccard.DEPTH:
                row[d + n] = base[d + n] + 1
        i, j = np.triu_indices(len(sig), 1)
        fi, fj, depth = jaccard.shortened(sig[:, d : jaccard.DEPTH], (sig & 255).astype(np.uint8), i, j, d)
        return depth, set(zip(fi.tolist(), fj.tolist(), strict=True))

    deep, found = depths([0.99, 0.98], [3, 3])
    assert deep.tolist() == [jaccard.DEPTH] * 3 and {(0, 1), (0, 2)} <= found
    lone, found = depths([0.82, 0.1], [0, 0])
    assert lone.tolist() == [d, d, d] and found == {(0, 1)}
    mixed, found = depths([0.99, 0.84], [3, 1])
    assert mixed[0] == mixed[1] == jaccard.DEPTH and mixed[2] < jaccard.DEPTH and (0, 2) in found


def test_recall_of_pairs_near_the_threshold(spark):
    r = np.random.default_rng(12)
    rows, want = [], set()
    for i in range(400):
        w = [f"a{x}" for x in r.integers(0, 10**7, 120)]
        at = sorted(r.choice(np.arange(2, 118, 6), int(r.integers(1, 3)), replace=False))
        v = [f"b{i}" if j in at else x for j, x in enumerate(w)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        a, b = util.shingles(rows[-2][1]), util.shingles(rows[-1][1])
        if len(a & b) >= 0.8 * len(a | b):
            want.add(2 * i + 1)
    found = {x["doc_id"] for x in rows_of(jaccard.near_duplicates(util.docs(spark, rows))) if x["n_links"] and x["doc_id"] % 2}
    assert len(want) > 200 and found <= want and len(found) >= 0.995 * len(want)


def test_packing_matches_plain_encoding(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    pieces = rows_of(packing.pack(util.docs(spark), path))
    sequences: dict[int, list] = {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] and p["length"] > 0
        sequences.setdefault(p["sequence_id"], []).append(p)
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == ps[0]["sequence_tokens"] <= 1024 and (at == 1024 or at & (at - 1) == 0)
    once = {i: t for i, t in util.texts() if i not in (None, 1, 4)}
    for i, t in once.items():
        mine = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        ids = np.concatenate([np.frombuffer(bytes(p["ids"]), "<u4") for p in mine]).tolist()
        assert ids == plain.encode(t or "", add_special_tokens=False).ids + [0]
        assert all(p["doc_tokens"] == len(ids) for p in mine) and [p["start"] for p in mine] == np.cumsum([0, *[p["length"] for p in mine]])[:-1].tolist()
    digest = packing.as_digest(packing.pack(util.docs(spark, [(5, "a b c")]), path)).first()
    assert digest["ids_crc32"] == zlib.crc32(np.array(plain.encode("a b c", add_special_tokens=False).ids + [0], "<u4").tobytes())


def test_assign_balances_cost():
    pieces, rooms = packing.assign([1000, 24, 512, 512, 100, 900, 24])
    used = Counter()
    for _, _, n, k, _ in pieces:
        used[k] += n
    assert [used[k] for k in range(len(rooms))] == rooms and sum(rooms) == 3072
    assert packing.assign([]) == ([], [])


def naive_assign(lengths, capacity):
    """The rule itself: the longest goes to the cheapest sequence with room, else fills the cheapest."""
    total = sum(lengths)
    rooms = [capacity] * (total // capacity) + [1 << b for b in range(20, -1, -1) if (total % capacity) >> b & 1]
    free, cost, out = rooms.copy(), [0.0] * len(rooms), []
    items = sorted((-n, i, 0) for i, n in enumerate(lengths) if n)
    while items:
        n, item, start = items.pop(0)
        n = -n
        fits = [k for k in range(len(rooms)) if free[k] >= n] or [k for k in range(len(rooms)) if free[k]]
        k = min(fits, key=lambda k: (cost[k], k))
        taken = min(n, free[k])
        out.append((item, start, taken, k, rooms[k] - free[k]))
        free[k] -= taken
        cost[k] += taken + taken * taken / 2048
        if taken < n:
            items = sorted([*items, (taken - n, item, start + taken)])
    return out, rooms


def test_assign_follows_the_rule():
    r = random.Random(8)
    for _ in range(60):
        lengths = [r.choice([0, 1, 5, 64, 700, 1023, r.randrange(1, 1024)]) for _ in range(r.randrange(1, 120))]
        assert packing.assign(lengths) == naive_assign(lengths, 1024)


def test_assign_finds_the_only_sequence_with_room():
    # twenty cheaper sequences have 284 left, only that of the piece of 700 can take 300
    lengths = [700, *[400] * 20, *[340] * 20, 300, *[284] * 20, 24]
    pieces, rooms = packing.assign(lengths)
    assert len(rooms) == 21 and len(pieces) == len(lengths)
    at = {p[0]: p[3] for p in pieces}
    assert at[41] == at[0]


def test_other_tokenizers_take_whole_texts():
    P = pytest.importorskip("public_tokenizers")
    import tokenizers

    path = P.path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    texts = ["Hello  world, it's 1 test\n\nof words", "", " x"]
    encode = packing.Encoder(path, 0)
    ids, at = encode(texts)
    assert encode.whole == (not packing._cuttable(plain))
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def lm_tokens(t):
    return [*util.words(util.lower(t or "")), None]


def test_lm_base_scores_match_brute_force(spark):
    rows = [(i, t) for i, t in util.texts() if i is not None]
    found = rows_of(lm.lm_scores(util.docs(spark, rows)))
    mod = lambda i: zlib.crc32(str(i).encode()) % 7
    c = Counter(w for i, t in rows if mod(i) != 2 for w in lm_tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, mod(i) == 2, len(lm_tokens(t)), sum(c[w] > 0 for w in lm_tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in lm_tokens(t)), 6)) for i, t in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_lm_weights_and_brute_force_score(spark):
    cells = np.array([[3, 8, 24, 50], [3, -1, 40, 10], [1, -1, -1, 5]])
    w = lm.expectation_maximisation(cells, 100)
    assert np.allclose(w.sum(1), 1) and w[3, 0] > 0.6 and w[1, 2] > 0.5 and w[0, 0] == 0
    rows = [(i, t) for i, t in util.texts() if i is not None]
    seen = {}

    def keep(weights, tokens, vocabulary, f=lm._scores):
        seen["w"] = weights
        return f(weights, tokens, vocabulary)

    old, lm._scores = lm._scores, keep
    try:
        found = rows_of(lm.lm_scores(util.docs(spark, rows)))
    finally:
        lm._scores = old
    train = [lm_tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    uni = Counter(w for t in train for w in t)
    bi = Counter(p for t in train for p in zip([0, *t[:-1]], t, strict=True))
    n, v, starts = sum(uni.values()), len(uni), len(train)
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in found}
    for i, t in rows:
        total, before = 0.0, 0
        for x in lm_tokens(t):
            h = starts if before == 0 else uni[before]
            l2, l1, l0 = seen["w"][int(lm.bucket(np.array([h]))[0])]
            total += math.log10(l2 * bi[before, x] / max(h, 1) + l1 * uni[x] / n + l0 / (v + 1))
            before = x
        assert math.isclose(got[i, len(lm_tokens(t))], total, rel_tol=1e-9)


def test_lm_packs_hashes():
    for n in (1, 2, 50, 5000):
        h = np.sort(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
        assert (tx.unpacked(tx.packed(h)) == h).all()
    assert lm._large(lm._small(np.array([0, 255, 70000, 254, 1 << 40]))).tolist() == [0, 255, 70000, 254, 1 << 40] and lm._large(lm._small(np.array([], dtype=np.int64))).tolist() == []


def test_lm_beats_the_base_on_held_out_prose(spark):
    import random

    r = random.Random(5)
    pairs = {f"a{i}": [f"a{r.randrange(60)}" for _ in range(2)] for i in range(60)}
    rows = []
    for i in range(200):
        w = ["a0"]
        while len(w) < 60:
            w.append(r.choice(pairs[w[-1]]))
        rows.append((i, " ".join(w)))
    held = [x for x in rows_of(lm.lm_scores(util.docs(spark, rows))) if x["held_out"]]
    assert held and sum(x["score"] for x in held) > 0.5 * sum(x["base_score"] for x in held)


LICENSED = [(1, "Released under the MIT License.\nmore"), (2, "under the\nmit license under the MIT license"), (3, "Apache License, Version 2.0 cc by nc"), (4, "permission is hereby granted free of charge to any person obtaining a copy of this software and"), (5, None), (6, ""), (7, "License GNU General Public version 3 is licensed under this work the"), (8, "the mit of under"), (8, "the mit of under"), (None, "CC-BY-NC")]


def license_brute(t):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", util.lower(t or ""))
    places, base, labels, score = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
                score = 1.0
    for line in (t or "").split("\n"):
        b = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", util.lower(line)))
        for text, label in licenses.TEMPLATES:
            s = set(text.split())
            if len(s & b) >= 0.8 * len(s) - 1e-9:
                labels.add(label)
                score = max(score, len(s & b) / len(s))
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), round(score, 9))


def test_license_scan_matches_brute_force(spark):
    rows = LICENSED + [(i, t) for i, t in util.texts()]
    found = rows_of(licenses.license_scan(util.docs(spark, rows)))
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in found)
    assert got == Counter((i, *license_brute(t)) for i, t in rows)


def test_license_scan_reads_over_line_ends_and_not_over_whole_texts(spark):
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    apache = " * you may not use this file except in\n * compliance with the License.\n * You may obtain a copy of the\n * License at"
    words = licenses.TEMPLATES[1][0].split()
    scattered = " ".join(f"{w} " + " ".join(f"x{i}y{j}" for j in range(20)) for i, w in enumerate(words))
    inside = " ".join(f"z{i}" for i in range(5000)) + f" {' '.join(words)} " + " ".join(f"z{i}" for i in range(5000))
    across = [(5, " ".join(words[:12])), (6, " ".join(words[12:]))]
    rows = [(1, wrapped), (2, apache), (3, scattered), (4, inside), *across, (7, "\n".join(words))]
    found = {r["doc_id"]: (r["labels"], r["score"]) for r in rows_of(licenses.license_scan(util.docs(spark, rows).coalesce(1)))}
    assert found == {1: ("mit", 1.0), 2: ("apache-2", 1.0), 3: ("", 0.0), 4: ("mit", 1.0), 5: ("", 0.0), 6: ("", 0.0), 7: ("mit", 1.0)}


def test_license_windows_match_brute_force():
    r = np.random.default_rng(3)
    vocabulary = licenses._vocabulary(licenses.TEMPLATES, licenses.PHRASES)
    scan = licenses._Scan(vocabulary, np.arange(len(vocabulary)), licenses.TEMPLATES, licenses.PHRASES, licenses.THRESHOLD)
    texts = []
    for k in range(60):
        words = licenses.TEMPLATES[k % len(licenses.TEMPLATES)][0].split()
        texts.append("".join(w + r.choice([" ", "\n"]) + "filler " * int(r.integers(0, 3)) for w in words if r.random() < 0.9) * int(r.integers(1, 3)))
    for t, row in zip(texts, scan.run(licenses.pa.array(texts)), strict=True):
        w, want = t.split(), {}
        for text, label in licenses.TEMPLATES:
            need = set(text.split())
            best = max(len(need & set(w[i : i + licenses.WINDOW * len(text.split())])) for i in range(len(w)))
            if best >= licenses.THRESHOLD * len(need) - 1e-9:
                want[label] = max(want.get(label, 0), best / len(need))
        score = max([1.0 if row[4] else 0.0, *want.values()])
        assert (set(row[5].split(",")) - {""}, row[6]) == (set(want) | set(row[4].split(",")) - {""}, score)


def test_empty_tables(spark):
    P = pytest.importorskip("public_tokenizers")
    none = util.docs(spark, [])
    for df in (quality.quality_rules(none), quality.quality_filter(none), substring.substring_dedup(none), substring.substring_stage(none), jaccard.near_duplicates(none), jaccard.near_duplicate_stage(none), packing.pack(none, P.path("byte_bpe_50k.json")), lm.lm_scores(none), licenses.license_scan(none)):
        assert df.count() == 0
