"""Labels, tenancy rules and exported history."""

import datetime as dt
import io
import tarfile

from pyspark.sql import functions as F

from lattica.operators import history, labels, tenancy
from lattica.sources import git


def test_labels_with_and_without_a_model(spark):
    n = spark.createDataFrame([(f"c{i % 10}", f"src/user-area/f{i}.ts", 0.1 * i, "about users") for i in range(40)], "cluster_id string, canonical_path string, centrality_score double, text_summary string")
    plain = {r["cluster_id"]: r for r in labels.label_clusters(n).collect()}
    assert plain["c1"]["title"] == "User Area Module" and plain["c1"]["summary"] == "Group of 4 files"
    asked = labels.prompts(n).collect()
    assert sorted(p["prompt"].count("Cluster c") for p in asked) == [2, 8]
    said = labels.label_clusters(n, lambda p: 'Sure: [{"cluster_id": "c1", "title": "T"}] done' if "Cluster c1:" in p else 1 / 0)
    got = {r["cluster_id"]: r["title"] for r in said.collect()}
    assert got["c1"] == "T" and got["c9"] == "User Area Module"


def test_no_more_calls_after_a_failed_one(spark):
    asked = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "batch long, prompt string")
    said = labels.answered(asked, lambda p: '[{"cluster_id": "%s"}]' % p if p != "p1" else 1 / 0, labels.ANSWER)
    assert [r["cluster_id"] for r in said.collect()] == ["p0"]


def test_prompts_are_dealt_over_tasks_and_tried_again(spark, tmp_path):
    from pyspark import TaskContext

    asked = spark.createDataFrame([(i, f"p{i:02d}") for i in range(40)], "batch long, prompt string")

    def model(p):
        mark = tmp_path / p
        if p.endswith("7") and not mark.exists():  # fails the first time
            mark.write_text("")
            raise ValueError(p)
        if p == "p03":
            raise ValueError(p)  # fails always, so its task stops there
        return '[{"cluster_id": "%s", "title": "%d"}]' % (p, TaskContext.get().partitionId())

    found = labels.answered(asked, model, labels.ANSWER).collect()
    tasks = {r["title"] for r in found}
    assert len(tasks) == 4 and {r["cluster_id"] for r in found} >= {f"p{i:02d}" for i in range(20, 40)} and "p02" in {r["cluster_id"] for r in found} and "p04" not in {r["cluster_id"] for r in found}


def test_domain_validation_is_advisory(spark):
    c = spark.createDataFrame([("c1", "CANONICAL"), ("c2", "UNCLASSIFIED")], "cluster_id string, kind string")
    asked = spark.createDataFrame([(0, "p")], "batch long, prompt string")
    got = {r["cluster_id"]: r["llm_valid"] for r in labels.validate_domains(c, asked, lambda p: '[{"cluster_id":"c1","valid":false},{"cluster_id":"c2","valid":true}]').collect()}
    assert got == {"c1": False, "c2": None}
    assert labels.validate_domains(c, asked).where("llm_valid is null").count() == 2


def test_tenancy_rules(spark):
    m = spark.createDataFrame([(1, 5, "OWNER"), (1, 6, "MEMBER"), (2, 6, "ADMIN")], "org_id long, user_id long, role string")
    u = spark.createDataFrame([(5, "a")], "user_id long, email string")
    assert {r["user_id"]: r["email"] for r in tenancy.members_with_profiles(m, u).collect()} == {5: "a", 6: None}
    o = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "org_id long, name string")
    p = spark.createDataFrame([(10, 1), (11, 2)], "project_id long, org_id long")
    assert [r["org_id"] for r in tenancy.deletable(o, p).collect()] == [3]
    assert {r["org_id"] for r in tenancy.organisations_of(6, m, o).collect()} == {1, 2}
    pm = spark.createDataFrame([(10, 6), (11, 6), (10, 5)], "project_id long, user_id long")
    om, rest = tenancy.left(6, 1, m, pm, p)
    assert om.count() == 2 and {tuple(r) for r in rest.select("project_id", "user_id").collect()} == {(11, 6), (10, 5)}
    assert tenancy.left(5, 1, m, pm, p)[0].count() == 3
    members = spark.createDataFrame([(10, 5, "OWNER"), (10, 6, "MEMBER")], "project_id long, user_id long, role string")
    ch = spark.createDataFrame([(10, 5, None), (10, 6, "ADMIN"), (10, 6, None), (10, 9, "ADMIN")], "project_id long, user_id long, new_role string")
    assert sorted(r["status"] for r in tenancy.member_changes(members, ch).collect()) == ["FORBIDDEN", "NOT_FOUND", "REMOVED", "UPDATED"]
    now = F.lit(dt.datetime(2024, 1, 2))
    inv = spark.createDataFrame([(1, "A@b", "PENDING", dt.datetime(2024, 1, 1)), (1, "c@d", "PENDING", dt.datetime(2024, 2, 1))], "org_id long, email string, status string, expires_at timestamp")
    ask = spark.createDataFrame([(1, "a@B"), (1, "c@d"), (1, "e@f")], "org_id long, email string")
    assert {r["email"]: r["result"] for r in tenancy.invited(inv, ask, now).collect()} == {"a@b": "RENEWED", "c@d": "CONFLICT", "e@f": "CREATED"}
    notes = spark.createDataFrame([(1, 10, 6), (2, 10, 5)], "note_id long, project_id long, author_id long")
    assert {r["note_id"] for r in tenancy.deletable_notes(notes, members, 6).collect()} == {1}
    assert tenancy.deletable_notes(notes, members, 5).count() == 2


def test_history_from_exports(spark):
    text = "\x01s2\x02Ann\x02a@x\x02200\x02two\n\nM\ta.js\nR100\told.js\tnew.js\nD\tz.js\n\x01s1\x02Bob\x02b@x\x02100\x02one\n\nA\ta.js\n\x01s0\x02Bob\x02b@x\x0250\x02empty\n"
    rows = git.log(spark.createDataFrame([("p", bytearray(text.encode()))], "key string, content binary"))
    assert rows.count() == 5
    files = {r["sha"]: r for r in history.commit_files(rows.where("path is not null")).collect()}
    assert files["s2"]["modified"] == ["a.js", "new.js"] and files["s2"]["deleted"] == ["z.js"] and files["s1"]["added"] == ["a.js"]
    assert [r["sha"] for r in git.last_commits(rows, 2).collect()] == ["s2", "s1"]
    both = git.log(spark.createDataFrame([("p", bytearray(text.encode())), ("q", bytearray(text.encode()))], "key string, content binary"))
    assert [(r["project"], r["sha"]) for r in git.last_commits(both, 1).collect()] == [("p", "s2"), ("q", "s2")]
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as z:
        for name in ("a.js", "Dist/b.js", "src/dist/c.js"):
            entry = tarfile.TarInfo(name)
            entry.size = 1
            z.addfile(entry, io.BytesIO(b"x"))
    tree = git.commit_tree(spark.createDataFrame([("s1", bytearray(raw.getvalue())), ("s2", None)], "sha string, content binary"))
    assert {(r["sha"], r["canonical_path"]) for r in tree.collect()} == {("s1", "a.js"), ("s1", "src/dist/c.js")}
    porcelain = "h 1 1 2\nauthor Ann\nauthor-mail <a@x>\n\tline 1\nh 2 2\n\tline 2\nk 3 3\nauthor Not Committed Yet\nauthor-mail <none>\n\tline 3\n"
    b = git.blame(spark.createDataFrame([("a.js", bytearray(porcelain.encode()))], "key string, content binary"))
    assert [(r["line"], r["author"]) for r in b.orderBy("line").collect()] == [(1, "Ann"), (2, "Ann"), (3, None)]
    got = history.ownership(b.select("path", "author")).collect()
    assert [(r["author"], r["percentage"]) for r in got] == [("Ann", 100.0)]


def test_notes_are_added_by_members(spark):
    notes = spark.createDataFrame([(7, 10, 5, "x", dt.datetime(2024, 1, 1))], "note_id long, project_id long, author_id long, text string, created_at timestamp")
    asked = spark.createDataFrame([(10, 5, " hi "), (10, 6, "a"), (11, 5, "b"), (10, 5, "  "), (12, 9, "no")], "project_id long, author_id long, text string")
    members = spark.createDataFrame([(10, 5), (10, 6), (11, 5)], "project_id long, user_id long")
    new, judged = tenancy.noted(notes, asked, members, F.lit(dt.datetime(2024, 1, 2)))
    assert sorted((r["note_id"], r["project_id"], r["text"]) for r in new.collect()) == [(8, 10, "hi"), (9, 10, "a"), (10, 11, "b")]
    assert sorted(r["result"] for r in judged.collect()) == ["ADDED", "ADDED", "ADDED", "EMPTY", "FORBIDDEN"]
    assert tenancy.noted(notes.where("false"), asked.where("false"), members, F.lit(None).cast("timestamp"))[0].collect() == []
