"""The pruned crawl and tables that change all at once."""

import io
import json
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lattica.operators import history
from lattica.sources import archives, code, sinks, tree, versions


def test_skipped_directories_are_never_opened():
    held = {"": (["src", "node_modules", "dist"], [("a.js", 3)]), "src": (["node_modules", "deep"], [("b.TS", 1), ("c.md", 1), (".js", 1)]), "src/deep": ([], [("d.mjs", 1)])}
    opened = []

    def listing(path):
        opened.append(path)
        return held[path]  # any other directory can't be opened

    found = list(tree.walk(listing, frozenset({"node_modules", "dist"}), frozenset({".js", ".ts", ".mjs"})))
    assert sorted(p for p, _ in found) == ["a.js", "src/b.TS", "src/deep/d.mjs"] and sorted(opened) == ["", "src", "src/deep"]


def test_files_are_dealt_by_bytes_and_number():
    files = [(f"f{i}", 10) for i in range(25)] + [("huge", 1000), ("last", 1)]
    parts = list(tree.dealt(iter(files), 100, 8))
    assert [p for x in parts for p in x.paths] == [p for p, _ in files]
    assert all(len(x.paths) <= 8 for x in parts) and ("huge",) in [x.paths for x in parts]


def test_crawl_reads_links_and_odd_bytes(spark, tmp_path):
    (tmp_path / "ok dir").mkdir()
    (tmp_path / "ok dir" / "é.js").write_bytes(b"a\xffb")
    (tmp_path / "node_modules").mkdir()
    os.symlink("/nowhere/at/all", tmp_path / "node_modules" / "broken.js")
    os.symlink(tmp_path, tmp_path / "ok dir" / "loop")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        assert [tuple(r) for r in code.crawl(spark, root).collect()] == [("ok dir/é.js", "a�b")]
    (tmp_path / "empty").mkdir()
    assert code.crawl(spark, str(tmp_path / "empty")).collect() == []


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def held(store, table="t", **kw):
    return sorted(r["v"] for r in store.read(table, **kw).collect())


def test_a_version_is_there_as_a_whole_or_not_at_all(spark, tmp_path):
    store = versions.Versions(spark, f"{tmp_path}/s")
    assert store.current() == 0
    store.commit({"t": rows(spark, 1, 2), "u": rows(spark, 9)}, "a")
    store.commit({"t": rows(spark, 3)}, "b")
    store.commit({"t": rows(spark, 3)}, "b")  # the same tag again
    assert held(store) == [1, 2, 3] and held(store, tag="b") == [3] and held(store, version=1) == [1, 2] and store.has("t", "a")
    broken = spark.range(1).select(F.raise_error(F.lit("killed")).cast("long").alias("v"))
    with pytest.raises(Exception, match="killed"):
        store.commit({"t": rows(spark, 4), "u": broken}, "c")  # one table is written, the other isn't
    assert store.current() == 3 and held(store) == [1, 2, 3] and held(store, "u") == [9]
    os.makedirs(tmp_path / "s" / "data" / "left" / "t")  # by a killed writer
    assert store.vacuum(keep=3) == 1 and held(store, version=2) == [1, 2, 3]
    store.commit({"t": rows(spark)}, replace=("t",))
    assert held(store) == [] and store.manifest().folders["t"] and held(store, "u") == [9]


def test_of_two_writers_one_conflicts(spark, tmp_path):
    one, two = (versions.Versions(spark, f"{tmp_path}/s") for _ in range(2))
    one.commit({"t": rows(spark, 1)}, "a")
    seen = two.current()
    one.commit({"t": rows(spark, 2)}, "b")
    with pytest.raises(versions.Conflict):
        two.commit({"t": rows(spark, 3)}, "c", expected=seen)
    assert held(two) == [1, 2] and two.vacuum(keep=9) == 0  # the loser took its data away


def test_a_dead_writer_blocks_nobody(spark, tmp_path, monkeypatch):
    store = versions.Versions(spark, f"{tmp_path}/s")
    store.commit({"t": rows(spark, 1)}, "a")
    (tmp_path / "s" / "_versions" / f"{2:020d}.claim0").write_bytes(b"")  # by a writer that was killed
    with pytest.raises(versions.Conflict):
        store.commit({"t": rows(spark, 2)}, "b")  # it may be alive yet
    monkeypatch.setattr(versions, "CLAIM_SECONDS", -1)
    assert store.commit({"t": rows(spark, 2)}, "b") == 2 and held(store) == [1, 2]
    assert not [x for x in os.listdir(tmp_path / "s" / "_versions") if "claim" in x and not x.endswith(".crc")]


def test_a_transaction_is_stored_once(spark, tmp_path):
    store = versions.Versions(spark, f"{tmp_path}/s")
    for number in (0, 0, 1, 0, 1):
        store.commit({"t": rows(spark, number)}, str(number), transaction=("stream", number))
    assert held(store) == [0, 1] and store.current() == 2
    with pytest.raises(KeyError):
        store.read("other")


def test_many_folders_become_one(spark, tmp_path):
    store = versions.Versions(spark, f"{tmp_path}/s")
    store.commit({"t": rows(spark, 1)}, "a")
    m = store.manifest()
    m.folders["t"] *= 2
    m.version += 1
    store._put(m)
    store.compact("t")
    assert held(store) == [1, 1] and len(store.manifest().folders["t"]) == 1


def test_optimistic_changes_of_a_stored_table(spark, tmp_path):
    store = versions.Versions(spark, f"{tmp_path}/s")
    ask = lambda *x: spark.createDataFrame(list(x), "path string, value string, expected long")
    first = versions.upserted(store, "overrides", "path", ask(("a", "c2", None), ("b", "c1", 4)))
    assert {r["path"]: r["status"] for r in first.collect()} == {"a": "INSERTED", "b": "CONFLICT"}
    second = versions.upserted(store, "overrides", "path", ask(("a", "c3", 0)))
    third = versions.upserted(store, "overrides", "path", ask(("a", "c4", 0)))
    assert second.first()["status"] == "UPDATED" and third.first()["status"] == "CONFLICT"
    assert [tuple(r) for r in store.read("overrides").collect()] == [("a", "c3", 1)]


def test_archives_are_read_by_range(spark, tmp_path):
    data = {f"src/f{i}.js": os.urandom(20_000) + b"a" * 30_000 for i in range(40)} | {"empty.js": b"", "big.js": b"b" * 400_000}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in data.items():
            z.writestr(name, text, zipfile.ZIP_STORED if name.endswith("3.js") else zipfile.ZIP_DEFLATED)
        for name in ("node_modules/x.js", "../evil.js", "d/", "a\\bin\\y.js"):
            z.writestr(name, "x")
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        for name, text in (data | {"dist/x.js": b"x", "long/" * 40 + "n.js": b"n"}).items():
            x = tarfile.TarInfo(name)
            x.size = len(text)
            t.addfile(x, io.BytesIO(text))
    found = archives.entries(spark, [str(tmp_path / "a.zip"), f"file://{tmp_path}/b.tar"], 200_000)
    assert found.rdd.getNumPartitions() > 20
    got = {}
    for r in found.collect():
        got.setdefault(r["archive"].rsplit("/", 1)[1], {})[r["canonical_path"]] = bytes(r["content"])
    assert got["a.zip"] == data and got["b.tar"] == data | {"long/" * 40 + "n.js": b"n"}


class Counting(io.BytesIO):
    read_bytes = 0

    def read(self, *a):
        out = super().read(*a)
        Counting.read_bytes += len(out)
        return out


def test_a_directory_costs_its_own_bytes():
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for i in range(5):
            x = tarfile.TarInfo(f"f{i}")
            x.size = 1 << 20
            t.addfile(x, io.BytesIO(bytes(1 << 20)))
    f = Counting(raw.getvalue())
    assert len(list(archives.tar_directory("x", f))) == 5 and Counting.read_bytes < 64 << 10


def test_a_large_archive_makes_many_tasks():
    listed = (archives.Entry("x.zip", f"f{i}", i << 20, 1 << 20, 1 << 20, 8) for i in range(3000))  # 3 GB
    parts = list(archives.dealt(listed))
    assert len(parts) > 90 and max(sum(e.size for e in p.entries) for p in parts) <= tree.PART_BYTES


def test_delta_documents_equal_the_row(spark, tmp_path):
    prev = spark.createDataFrame([(f"f{i}", f"c{i % 3}") for i in range(9)] + [('q"[uo]te', "old")], "path string, cluster_id string")
    new = spark.createDataFrame([(f"f{i}", f"c{(i + i // 6) % 4}") for i in range(3, 12)], "path string, cluster_id string")
    delta = history.snapshot_delta(prev, new)
    sinks.write_delta_document(delta, prev, new, f"{tmp_path}/d.json")
    with open(tmp_path / "d.json") as f:
        got = json.load(f)
    row = history.delta_document(delta, prev, new).first().asDict(recursive=True)
    assert got == row and got["removed_clusters"] == ["old"] and 'q"[uo]te' in got["removed_nodes"]


def test_rows_of_a_snapshot_replace_those_it_had(spark, tmp_path):
    root = f"{tmp_path}/s"
    notes = lambda *x: spark.createDataFrame([(i,) for i in x], "note_id long")
    sinks.persist_rows(notes(1, 2), "notes", "s1", root)
    at = sinks.persist_rows(notes(3), "notes", "s2", root)
    sinks.persist_rows(notes(1, 2, 4), "notes", "s1", root)
    assert sorted(r["note_id"] for r in sinks.stored_rows(spark, root, "notes", "s1").collect()) == [1, 2, 4]
    assert [tuple(r) for r in sinks.stored_rows(spark, root, "notes", "s2").collect()] == [("s2", 3)]
    with pytest.raises(versions.Conflict):
        sinks.rewrite_clusters(root, "s1", spark.createDataFrame([("c", True)], "cluster_id string, llm_valid boolean"), at)
