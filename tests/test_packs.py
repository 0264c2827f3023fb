"""History read from a repository's own files, against its exports."""

import io
import os
import random
import shutil
import subprocess
import tarfile

import pytest

from lattica.sources import git, packs

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="no git to make a repository with")


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    """Forty commits with edits, copies, renames, deletions, a merge and an empty commit; packed, with loose objects on top."""
    top = tmp_path_factory.mktemp("history")
    env = os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}
    r = random.Random(2)

    def run(*args, day=0, who="ann"):
        at = f"2024-01-01T00:{day // 60:02d}:{day % 60:02d}+02:00"
        names = {f"GIT_{x}_{y}": v for x in ("AUTHOR", "COMMITTER") for y, v in (("NAME", who), ("EMAIL", f"{who}@x.org"), ("DATE", at))}
        return subprocess.run(["git", *args], cwd=top, env=env | names, check=True, capture_output=True).stdout

    def commit(day, *extra):
        run("add", "-A")
        run("commit", "-q", "-m", f"change {day}\n\nwhy", *extra, day=day, who=r.choice(["ann", "bob é"]))

    run("init", "-q", "-b", "main")
    for day in range(40):
        for _ in range(2):
            p = top / r.choice(["a", "b/c", "b/d/e", "node_modules"]) / f"f{r.randrange(6)}.ts"
            p.parent.mkdir(parents=True, exist_ok=True)
            old = p.read_text().splitlines() if p.exists() else [f"{p.name} line {i} of {day}" for i in range(300)]
            old[r.randrange(len(old))] = f"changed on {day} é"
            p.write_text("\n".join(old) + "\n")
        if day == 10:
            (top / "b" / "c").rename(top / "b" / "moved")
        if day == 12:
            shutil.rmtree(top / "b" / "d", ignore_errors=True)
        if day == 15:
            run("checkout", "-q", "-b", "side")
        if day == 18:
            run("checkout", "-q", "main")
            (top / "only-main.ts").write_text("x\n")
            commit(18)
            run("merge", "-q", "-X", "theirs", "-m", "merge side", "side", day=19)
            continue
        if day == 30:
            run("gc", "-q", "--aggressive")
        commit(day, "--allow-empty")
    run("commit", "-q", "--allow-empty", "-m", "nothing", day=59)
    return top, run


def test_objects_are_those_of_the_repository(spark, repository):
    top, run = repository
    got = packs.objects(spark, f"{top}/.git", 4096)
    assert got.rdd.getNumPartitions() > 3
    want = {tuple(line.split()[:2]) for line in run("cat-file", "--batch-all-objects", "--batch-check").decode().splitlines()}
    rows = got.collect()
    assert {(r["sha"], r["kind"]) for r in rows} == want and len(rows) == len(want)
    assert any(n.endswith(".pack") for n in os.listdir(top / ".git" / "objects" / "pack"))
    for r in rows:
        import hashlib

        assert hashlib.sha1(f"{r['kind']} {len(r['content'])}\0".encode() + bytes(r["content"])).hexdigest() == r["sha"]


def test_log_equals_the_export(spark, repository):
    top, run = repository
    text = run("log", "--all", "--name-status", "-m", "--first-parent", "-M100%", "--root", f"--format={git.LOG_FORMAT}")
    exported = git.log(spark.createDataFrame([("p", bytearray(text))], "key string, content binary"))
    own = packs.log(packs.objects(spark, f"{top}/.git"), "p")
    shas = exported.select("sha").distinct()
    order = lambda df: sorted((tuple(r) for r in df.select(sorted(own.columns)).distinct().collect()), key=str)
    got = order(own.join(shas, "sha", "left_semi"))
    assert got == order(exported) and own.where("kind = 'RENAME'").count() > 0 and own.where("path is null").count() > 0


def test_files_of_a_commit_equal_the_archive(spark, repository):
    top, run = repository
    shas = run("log", "--format=%H").decode().split()
    asked = [shas[0], shas[20]]
    got = {}
    for r in packs.commit_files(packs.objects(spark, f"{top}/.git", 1 << 14), spark.createDataFrame([(s,) for s in asked], "sha string")).collect():
        got.setdefault(r["sha"], {})[r["canonical_path"]] = bytes(r["content"])
    for sha in asked:
        with tarfile.open(fileobj=io.BytesIO(run("archive", sha))) as t:
            assert got[sha] == {x.name: t.extractfile(x).read() for x in t if x.isfile() and not x.name.startswith("node_modules/")}


def test_equal_trees_are_not_entered(spark):
    entries = spark.createDataFrame([("n", "same", True, "40000", "s"), ("o", "same", True, "40000", "s"), ("n", "d", True, "40000", "n2"), ("o", "d", False, "100644", "f"), ("n2", "x", False, "100644", "g")], "tree string, name string, is_dir boolean, mode string, sha string")
    pairs = spark.createDataFrame([(1, "n", "o"), (2, "n", "n")], "id int, new_tree string, old_tree string")
    assert sorted(map(tuple, packs.tree_changes(pairs, entries).select("id", "path", "kind").collect())) == [(1, "d", "DELETE"), (1, "d/x", "ADD")]
