"""The pipeline against a brute-force version of its four stages."""

import math
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lattica.llm import quality

from . import util

COMMON = sorted({w for ws in quality.COMMON.values() for w in ws})


def hists(t):
    chars = Counter()
    for c in t or "":
        b = ord(c)
        chars["up" if "A" <= c <= "Z" else "low" if "a" <= c <= "z" else "num" if "0" <= c <= "9" else "sp" if c == " " else "nl" if c == "\n" else "ws" if c in "\t\r\v\f" else "punct" if c in ".,;:!?'\"-()" else "sym" if c in "#*$%&|<>" else "wide" if b >= 0x80 else "other"] += 1
    w = Counter(x if x in COMMON else "" for x in util.words(util.lower(t or "")))
    return chars, w


def jsd(p, q):
    a, b = sum(p.values()), sum(q.values())
    if not a or not b:
        return 0.0
    s = 0.0
    for k in {*p, *q}:
        x, y = p[k] / a, q[k] / b
        m = (x + y) / 2
        s += (x * math.log2(x / m) if x else 0) + (y * math.log2(y / m) if y else 0)
    return math.sqrt(max(0.0, s / 2))


def kept_by_quality(rows):
    refs: dict = {}
    for _, t, lang in rows:
        c, w = hists(t)
        for key in ([lang] if lang in quality.COMMON else ["?"]) + ["*"]:
            refs.setdefault(key, (Counter(), Counter()))
            refs[key][0].update(c)
            refs[key][1].update(w)
    out = []
    for i, t, lang in rows:
        n, *_, failed = util.quality(t)
        c, w = hists(t)
        rc, rw = refs[lang if lang in quality.COMMON else "*"]
        odd = n >= quality.MIN_WORDS and lang in quality.COMMON and (jsd(c, rc) > quality.MAX_CHARS or jsd(w, rw) > quality.MAX_WORDS)
        if not failed and not odd:
            out.append((i, t, lang))
    return out


def one_of_each_group(rows):
    sets = [(i, util.shingles(t)) for i, t, _ in rows]
    group = {i: i for i, _ in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if i != j and x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                lo, hi = sorted((root(i), root(j)))
                group[hi] = lo
    return [r for r in rows if root(r[0]) == r[0]]


def corpus():
    r = random.Random(11)
    vocab = {lang: ["".join(r.choice("abcdehinrst") for _ in range(r.randint(2, 8))) for _ in range(400)] for lang in ("en", "de")}
    prose = lambda lang, n: " ".join(r.choice(quality.COMMON[lang] if r.random() < 0.4 else vocab[lang]) for _ in range(n))
    rows = [(i, prose(("en", "de")[i % 2], 60 + 7 * (i % 30)), ("en", "de")[i % 2]) for i in range(60)]
    passage = prose("en", 60)
    rows += [(100 + i, prose("en", 120) + "\n" + passage + "\n" + prose("en", 80), "en") for i in range(4)]
    base = prose("en", 200).split()
    rows += [(200 + i, " ".join(base[:50] + [f"x{i}"] + base[51:]), "en") for i in range(6)] + [(300, " ".join(base), "en"), (301, " ".join(base), None)]
    rows += [(400, " ".join("#*$%"[j % 4] * 3 + str(j) for j in range(200)), "en"), (401, "short text", "en"), (402, None, "de"), (403, "", "xx")]
    return rows


def test_pipeline_equals_brute_force(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows = corpus()
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = kept_by_quality(rows)
    assert 400 not in {i for i, _, _ in good} and len(good) > 60
    unique = one_of_each_group(good)
    assert len(good) - len(unique) >= 6
    cut = util.substring([(i, t) for i, t, _ in unique])
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found: dict = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        found.setdefault(p["doc_id"], []).extend(np.frombuffer(bytes(p["ids"]), "<u4").tolist())
    texts = {i: plain.decode(ids[:-1], skip_special_tokens=False) for i, ids in found.items()}
    assert {i: " ".join(util.words(t)) for i, t in texts.items()} == {i: v[2] for (i, _), v in cut.items() if v[2]}
    assert all(ids[-1] == 0 and ids[:-1] == plain.encode(texts[i], add_special_tokens=False).ids for i, ids in found.items())
    assert sum(v[1] for v in cut.values()) >= 180


@pytest.mark.parametrize("some", [[], [(None, None)] * 3 + [(None, ""), (1, None), (1, None), (2, "")]])
def test_pipeline_of_empty_and_null_tables(spark, tmp_path, some):
    pytest.importorskip("public_tokenizers")
    util.docs(spark, some).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_carries_null_ids_and_repeated_rows(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    text = corpus()[0][1]
    util.docs(spark, [(None, text), (None, text), (5, text), (5, text), (None, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    found = {(p["doc_id"], p["start"]) for p in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {d for d, _ in found} <= {5, None} and (5, 0) in found


def test_stages_keep_the_columns(spark, tmp_path):
    docs = util.docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.names == docs.schema.names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "substring_dedup", "packing"]


def test_quality_verdicts_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality.quality_rules(df).collect() if r["kept"]}
    assert kept == {i for i, _, _ in kept_by_quality(rows)}
