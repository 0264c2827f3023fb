"""The filter audit against applying every order to every document."""

import random
from itertools import permutations

from lattica.llm import audit
from lattica.operators import joins

from . import util


def brute(rows, labels):
    """Rows by (part, order, step) from a list of (doc_id, text, source)."""
    last = float("inf")
    first = {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", last), last if i is None else i)
    good, toxic = ({i for i, *f in labels if i is not None and f[k] == 1} for k in (0, 1))
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = util.words(t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": (last if i is None else i) > first[t]}
        docs.append((s or "", {f for f in bad if bad[f]}, i in good, i in toxic))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = gone = [d for d in docs if d[0] == part]
            whole = left
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = sum(f in d[1] for d in whole)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in whole), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def fixture(seed=3):
    r = random.Random(seed)
    word = lambda n: " ".join(r.choice(["ab", "Cd", "e#", "fé", "g|h", "xyz", "K"]) + (str(k) if r.random() < 0.6 else "") for k in range(n))
    plain = lambda n: " ".join(f"wörd{k}" for k in range(n))
    texts = [word(r.choice([0, 5, 199, 200, 300])) for _ in range(40)] + [plain(n) for n in (199, 200, 201)] + ["a b " * 100, "x" * 70000 + " " + plain(400), None, "", " \n\t"]
    rows = [(r.choice([None, *range(30)]), r.choice(texts), r.choice([None, "", "s", "t"])) for _ in range(200)]
    rows += [(k, texts[-4], "hot") for k in range(60)] + [(500, plain(250), "only kept")]
    labels = [(r.choice([None, *range(40)]), r.choice([None, 0, 1]), r.choice([None, 0, 1])) for _ in range(60)]
    return rows, labels


def test_all_orders_equal_brute_force(spark):
    rows, labels = fixture()
    docs = spark.createDataFrame([(i, t, s, "z", "z", 1) for i, t, s in rows], "doc_id long, text string, source string, part string, fails string, state int").repartition(3)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got == brute(rows, labels)


def test_heavy_digests_are_broadcast(spark, monkeypatch):
    rows, labels = fixture(5)
    monkeypatch.setattr(joins, "HEAVY", 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r["part"], r["filter_order"], r["step"]): r["removed"] for r in audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got == {k: v[1] for k, v in brute(rows, labels).items()}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    got = audit.filter_audit(one, labels).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {""} and {r["good_lost"] for r in got} == {0}
