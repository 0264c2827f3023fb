"""The conversation trie against rebuilding every conversation in plain code."""

import hashlib
import random
import zlib

from lattica.llm import trie
from lattica.operators import joins

from . import util


def brute(rows):
    """Rows by (conv_id, depth); rows are (conv_id, turn, role, text)."""
    def digest(role, text):
        return hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()

    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, digest(role, text), role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c in own:
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    sums = {}

    def down(k):
        kids = children.get(k, [])
        found = [down(x) for x in kids]
        saved = (len(members[k]) - 1) * len(util.words(k[-1][1])) if k else 0
        sums[k] = (sum(f[0] for f in found) if kids else 1, saved + sum(f[1] for f in found))
        return sums[k]

    if members:
        down(())
    out = {}
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(full[c]) == len(k))
        out[min(m), len(k)] = (min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), *sums[k], hashlib.sha256(ends.encode()).hexdigest())
    return out


def got(spark, rows):
    df = spark.createDataFrame([(*r, b"z", 1) for r in rows], "conv_id long, turn long, role string, text string, key binary, base long").repartition(3)
    found = trie.conversation_trie(df).collect()
    out = {(r["conv_id"], r["depth"]): tuple(r[c] for c in ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in found}
    assert len(out) == len(found)
    return out


def fixture(seed=1):
    r = random.Random(seed)
    said = ["hello there", "a b\tc", "", None, "é " * 9, "bye"]
    rows = []
    for c in [*range(0, 130), *range(-45, -20), 161, 175, 10**12 + 7, 10**12]:
        for t in range(r.choice([1, 1, 2, 3, 5, 6])):
            rows.append((c, r.choice([t, t, None]) if r.random() < 0.1 else t, r.choice(["user", "user", "assistant", None]), r.choice(said)))
    rows += [(None, 0, "user", "x"), (5, 1, "user", "twice"), (5, 1, "user", "twice"), (9, None, None, None), (11, 0, "user", "word " * 300_000)]
    return rows


def test_trie_equals_brute_force(spark):
    rows = fixture()
    assert got(spark, rows) == brute(rows)


def test_copies_and_blocks(spark, monkeypatch):
    """One conversation in a third of the rows; ids in several blocks; parents both heavy and light."""
    monkeypatch.setattr(trie, "_BLOCK_BITS", 4)
    monkeypatch.setattr(joins, "HEAVY", 20)
    rows = fixture(2) + [(c, t, "user", f"same {t}") for c in range(2000, 2300) for t in range(2)]
    assert got(spark, rows) == brute(rows)


def test_turnless_deep_and_empty(spark):
    """A conversation whose turns are all replaced by an absent base; one of many turns; no rows."""
    lonely = next(c for c in range(2001, 2020) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lonely, 0, "user", "a"), (lonely, 1, "user", "b")]
    assert got(spark, rows) == brute(rows) and list(got(spark, rows)) == [(lonely, 0)]
    deep = [(40, t, "user", "go") for t in range(3000)]
    assert got(spark, deep)[40, 0] == (None, 1, 1, 1, 0, hashlib.sha256(b"").hexdigest())
    assert got(spark, []) == {}
