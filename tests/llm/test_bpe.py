"""The BPE operator against the library and against merging by rank."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import types as T

from lattica.llm import bpe

from . import util

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(texts, path=PATH):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    found = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    return found, [t.decode(ids, skip_special_tokens=False) for ids in found]


def test_digests_equal_the_library(spark):
    rows = [*util.texts(), (100, "<|endoftext|>It's <|startoftext|><|endoftext|>"), (101, "ΑΣ İx ﬁ é Å　\xa0\x85end"), (102, " ".join(t or "" for _, t in util.texts()) * 30)]
    assert max(len(t or "") for _, t in rows) > bpe._PART  # one text of several parts
    got = bpe.as_digest(bpe.decoded(bpe.encoded(util.docs(spark, rows), ["doc_id"], PATH), ["doc_id", "n_tokens", "ids"], PATH))
    ids, texts = expected([t for _, t in rows])
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(i, len(x), sha(b"".join(n.to_bytes(4, "little") for n in x)), sha(d.encode())) for (i, _), x, d in zip(rows, ids, texts, strict=True)]
    order = lambda r: (r[0] is None, *(str(x) for x in r))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_random_texts_equal_the_library():
    r, code = random.Random(5), bpe.Coder(PATH)
    alphabet = "abcdeèÉİΣς'stlmdrve  \n\t\xa0　\x1c\x85́̈각가漢123٣\xb2-_<|>.,!?\U0001f600‍</w>\x00\x01\x7f﻿"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    texts += [t[:9] + "<|endoftext|>" + t[9:] for t in texts[:200]]
    found, decoded = expected(texts)
    ids, at = code.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == found
    assert [code.decode(ids[a:b]).decode() for a, b in zip(at[:-1], at[1:], strict=True)] == decoded


@pytest.mark.parametrize("text", ["a" * 30000, "ab" * 20000, "!" * 9000, "the" * 9000])
def test_long_pieces(text):
    assert bpe.Coder(PATH).encode_long(text).tolist() == expected([text])[0][0]


def test_a_tokenizer_that_keeps_blanks_takes_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    import json

    with open(path) as f:
        if json.load(f).get("decoder"):
            with pytest.raises(ValueError):
                bpe.Coder(path)
            return
    code, texts = bpe.Coder(path), ["one two\nthree  four", " a\tb ", ""]
    assert [code.encode_long(t).tolist() for t in texts] == expected(texts, path)[0]


def merged(word, rank):
    """Merging the pair of least rank, leftmost first, until none is left."""
    while len(word) > 1:
        best = min(range(len(word) - 1), key=lambda i: (rank.get((word[i], word[i + 1]), 1e9), i))
        if (word[best], word[best + 1]) not in rank:
            break
        word[best : best + 2] = [word[best] + word[best + 1]]
    return word


@pytest.mark.parametrize("suffix", [None, "</w>"])
def test_backtracking_equals_merging(suffix):
    """Random merges over three letters, tokens that are never met included."""
    r = random.Random(11)
    for _ in range(40):
        vocab = ["a", "b", "c"] + ([x + suffix for x in "abc"] if suffix else [])
        merges = []
        for _ in range(60):
            x, y = r.choice(vocab), r.choice(vocab)
            if not (suffix and x.endswith(suffix)) and x + y not in vocab:
                vocab.append(x + y)
                merges.append([x, y])
        m = bpe.Merges({t: i for i, t in enumerate(vocab)}, merges, suffix)
        rank = {tuple(p): i for i, p in enumerate(merges)}
        words = ["".join(r.choice("abc") for _ in range(r.randint(1, 14))) for _ in range(60)]
        want = [[vocab.index(t) for t in merged([*w[:-1], w[-1] + (suffix or "")], rank)] for w in words]
        assert list(map(list, m.encode(words))) == want


def test_empty_table_null_ids_and_odd_names(spark):
    empty = spark.createDataFrame([], util.DOCS)
    assert bpe.encoded(empty, ["doc_id"], PATH).collect() == []
    kind = T.StructType().add("a.b", "long").add("ids", "binary")
    rows = spark.createDataFrame([(1, None), (2, bytearray(b"")), (None, bytearray(b"\x40\x01\x00\x00"))], kind)
    got = {r["a.b"]: r["decoded"] for r in bpe.decoded(rows, ["a.b"], PATH).collect()}
    assert got[1] is None and got[2] == "" and got[None]
    texts = spark.createDataFrame([(1, "x y")], T.StructType().add("a.b", "long").add("t.x", "string"))
    assert bpe.encoded(texts, ["a.b"], PATH, "t.x").collect()[0]["n_tokens"] == 2
