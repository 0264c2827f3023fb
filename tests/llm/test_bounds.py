"""Inputs past the bounds that operators once had: rare languages, odd names, prefix spaces, large components."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from lattica.llm import lm, packing, quality, substring, topk

RUSSIAN = "и в не на я что он с как это по но они мы к у из за".split()


def prose(words, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(words) + ("" if r.random() < 0.5 else "абвгдежз"[r.randrange(8)] * (1 if words is RUSSIAN else 0)) for _ in range(n))


@pytest.mark.parametrize("count", [1, 2, 3, 48, 52])
def test_languages_of_any_size_keep_their_documents(spark, count):
    rows = [(i, prose(quality.COMMON["en"], 200, i), "en") for i in range(20)] + [(100 + i, prose(RUSSIAN, 200, i), "ru") for i in range(count)] + [(300, prose(RUSSIAN, 200, 99), None)]
    found = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r["base_failed"] or r["kept"] for r in found) and sum(r["kept"] for r in found if r["doc_id"] >= 100) >= count


def test_more_languages_than_reach_every_task(spark):
    """Each of 1,100 languages is judged by its own documents, whether it is frequent or not."""
    junk = " ".join(f"{'#$%&'[j % 4] * 3}{j}{'*|' * 3}" for j in range(150))
    words = [f"wörd{k}" for k in range(60)]
    texts = {k: prose(words, 130, k) for k in range(5)}
    rows = [(10 * k + j, texts[(k + j) % 5], f"l{k}") for k in range(1100) for j in range(2)] + [(20005, junk, "big")] + [(20000 + j, texts[j], "big") for j in range(5) for _ in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    refs, rarer = quality.references(df)
    assert rarer.count() == 1100 and "big" in refs.row
    lost = {r["doc_id"] for r in quality.quality_rules(df).collect() if not r["kept"]}
    assert lost == {20005}
    assert quality.quality_filter(df).count() == len(rows) - 1


def test_stages_carry_columns_of_any_name(spark):
    text = " ".join(f"w{i % 90}" for i in range(120))
    kind = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("n_chars", "long")
    for c in ("a.b", "__lattica_block", "__lattica_w0", "row", "kept", "maybe", "ref", "__lattica_maybe"):
        kind = kind.add(c, "string")
    rows = [(i, t, "en", len(t), *"12345678") for i, t in [(1, text), (2, text), (3, text + " end"), (4, " ".join(f"x{i}" for i in range(130)))]]
    docs = spark.createDataFrame(rows, kind)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == kind.names
        assert {tuple(r)[4:] for r in docs.collect()} == {tuple("12345678")}
    assert {r["doc_id"] for r in docs.collect()} == {1, 4}
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()} == {1, 4}


def test_a_tokenizer_with_a_prefix_space_takes_whole_texts(tmp_path):
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        spec = json.load(f)
    spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    path = str(tmp_path / "prefix.json")
    with open(path, "w") as f:
        json.dump(spec, f)
    texts = ["one two\nthree four", "a\nb", " x", ""]
    ids, at = packing.Encoder(path, 0)(texts)
    want = [e.ids + [0] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_places_hold_every_word_of_the_longest_text():
    assert int(substring._PLACE) >= 2**30 - 1  # Spark's strings have fewer than 2**31 bytes
    h = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    _, begin, anchor = substring.anchors(h, np.array([0, 5000]), 20)
    assert len(begin) == 4981 and ((anchor >= begin) & (anchor <= begin + 10)).all()


def test_em_runs_until_weights_settle():
    r = np.random.default_rng(2)
    cells = np.stack([r.integers(0, 12, 4000), r.integers(-1, 90, 4000), r.integers(20, 160, 4000), r.integers(1, 500, 4000)], axis=1)
    a, b = lm.expectation_maximisation(cells, 10_000), lm.expectation_maximisation(cells, 10_000, 1e-12)
    assert np.abs(a - b).max() < 1e-3 and np.allclose(a.sum(1), 1)


def test_components_beyond_64_bits_raise(spark):
    def vectors(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        return df.select("vec_id", topk.whole("embedding").alias("v"))

    for rows in ([(0, [1e9]), (1, [1e9])], [(0, [1e300, 1.0]), (1, [1.0, 1.0])]):
        with pytest.raises(ValueError):
            topk.top_k(vectors(rows), F.col("vec_id") == 0)
    found = topk.top_k(vectors([(0, [4e7]), (1, [4e7])]), F.col("vec_id") == 0).collect()
    assert [r["score"] for r in found] == [(64 * 4 * 10**7) ** 2]


def test_vectors_of_ten_thousand_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_CELLS", 1 << 17)  # 13 rows a block
    r = np.random.default_rng(3)
    m = r.integers(-3, 4, (40, 10_000)) * (r.random((40, 10_000)) < 0.1)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id long, v array<long>")
    found = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in topk.top_k(rows, F.col("vec_id") % 20 == 0, 5).collect()}
    scores = m @ m.T
    for q in (0, 20):
        best = sorted((-scores[q, c], c) for c in range(40) if c != q)[:5]
        assert [found[q, k + 1] for k in range(5)] == [(c, -s) for s, c in best]


def test_more_templates_are_no_more_pairs():
    """A thousand templates whose words the texts don't hold make no candidates."""
    import pyarrow as pa

    from lattica.llm import licenses

    other = tuple((" ".join(f"w{k}x{j}" for j in range(12)), f"l{k}") for k in range(1000))
    texts = pa.array([f"{t} and more of it" for t, _ in licenses.TEMPLATES] + ["nothing here", None])

    def scan(templates):
        vocabulary = licenses._vocabulary(templates, licenses.PHRASES)
        return licenses._Scan(vocabulary, np.zeros(len(vocabulary), dtype=np.int64), templates, licenses.PHRASES, licenses.THRESHOLD)

    few, many = scan(licenses.TEMPLATES), scan((*licenses.TEMPLATES, *other))
    counted = []
    for s in (few, many):
        make = s.candidates
        s.candidates = lambda *a, make=make: counted.append(len(found := make(*a))) or found
    assert [r[5] for r in few.run(texts)] == [r[5] for r in many.run(texts)]
    assert counted[1] <= 2 * counted[0] and all(label in r[5] for r, (_, label) in zip(few.run(texts), licenses.TEMPLATES, strict=False))
