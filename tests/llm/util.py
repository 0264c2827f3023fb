"""Fixtures and brute-force versions for the tests of this folder."""

import random
import re
from collections import Counter

from pyspark.sql import types as T

DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")
for _c in ("row", "id", "key", "k", "part", "block", "component", "factors", "maybe", "sig", "kept", "__lattica"):
    DOCS = DOCS.add(_c, "string")  # names that the operators use inside
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(t):
    return WORD.findall(t or "")


def texts(seed: int = 7) -> list[tuple]:
    """Copies, near copies, shared passages, odd blanks, nulls, empty and long texts, repeated rows."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 6))) for _ in range(300)]
    some = lambda n: [r.choice(vocab) for _ in range(n)]
    base, passage = some(200), some(40)
    out = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base[:190] + some(4))), (4, " ".join(some(60) + passage + some(30))), (5, " ".join(some(10) + passage + some(80))), (6, "  ".join(some(20)) + "\n\n" + "\t".join(passage)), (7, None), (8, ""), (9, " \n\t "), (10, "one"), (11, "one"), (12, "a b c d"), (13, "a b c d e"), (14, " ".join(some(25)) + " " + " ".join(passage[:20]) + " " + " ".join(passage[:21])), (15, " ".join(["x"] * 100)), (16, "# $ % & | < >\nline one\nline one\n\n\nline one"), (17, " ".join(some(9000))), (18, "w" * 5000 + " " + "é" * 300)]
    out += [(20 + i, " ".join(base[:150] + [r.choice(vocab)] + base[151:])) for i in range(12)]
    out += [(1, " ".join(base)), (4, out[3][1]), (None, " ".join(base)), (None, " ".join(some(30))), (None, None)]
    return out


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, ("en", None, "xx", "de")[k % 4], None if k % 3 else "s", len(t or ""), *["z"] * 12) for k, (i, t) in enumerate(rows)], DOCS).repartition(3)


def substring(rows, n=20):
    """(n_words, n_removed, kept words) of each distinct (doc_id, text), by brute force."""
    last = float("inf")
    every = {(last if i is None else i, t) for i, t in rows}
    seen = {}
    for i, t in every:
        w = words(t)
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            seen[k] = min(seen.get(k, (last, last)), (i, s))
    out = {}
    for i, t in every:
        w = words(t)
        gone = set()
        for s in range(len(w) - n + 1):
            if seen[tuple(w[s : s + n])] < (i, s):
                gone.update(range(s, s + n))
        out[None if i == last else i, t] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def shingles(t, n=5):
    w = words(t)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def links(rows, least=0.8):
    """Links of each row with a doc_id, by brute force."""
    rows = [(i, shingles(t)) for i, t in rows if i is not None]
    out = Counter()
    for a, (i, x) in enumerate(rows):
        out[a] = sum(1 for b, (_, y) in enumerate(rows) if a != b and x and y and len(x & y) >= least * len(x | y) - 1e-9)
    return [(i, out[a]) for a, (i, _) in enumerate(rows)]


def quality(t):
    """The base measures of a text, by brute force."""
    t = t or ""
    w = words(t)
    at = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = set()
    for i in range(len(w) - 2):
        if at[tuple(w[i : i + 3])] > 1:
            rep.update((i, i + 1, i + 2))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep), n < 50 or 100 * len(rep) > 50 * n)
