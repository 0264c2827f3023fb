"""A small code base from files to tables."""

import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lattica.operators import analytics
from lattica.plans import analyze
from lattica.sources import code, sinks, versions

FILES = {
    "controllers/studentController.js": "const studentService = require('../services/studentService');\nconst logger = require('../config/logger');\nconst list = async (req, res) => {\n  res.json(await studentService.findAll());\n  studentService.findById(1);\n};\nmodule.exports = { list };\n",
    "services/studentService.js": "const findAll = async () => [];\nconst findById = async (id) => null;\n// const ghost = require('./nope');\nmodule.exports = { findAll, findById };\n",
    "config/logger.js": "const winston = require('winston');\nmodule.exports = winston;\n",
    "server.js": "const express = require('express');\nconst routes = require('./routes/studentRoutes');\nconst app = express();\napp.use('/api/students', routes);\n",
    "routes/studentRoutes.js": "const router = require('express').Router();\nconst c = require('../controllers/studentController');\nrouter.get('/all', c.list);\nmodule.exports = router;\n",
    "web/app/students/page.tsx": "import { load } from '@/api';\nimport Card from '@/components/Card';\nexport default function Page() { load(); bus.emit('page:opened'); return Card(); }\n",
    "web/app/layout.tsx": "export default function Layout() {}\n",
    "web/src/api.ts": "export function load() { return fetch(`/api/students/all`); }\nexport const unused = 1;\nbus.on('page:opened', () => 1);\n",
    "web/src/components/Card.tsx": "export const Card = 1;\n",
    "scripts/seed.js": "require('../config/logger');\n",
    "node_modules/x/index.js": "module.exports = 1;\n",
    "readme.md": "# no",
    "web/tsconfig.json": '{\n  // aliases\n  "compilerOptions": { "paths": { "@/*": ["./src/*"], }, }, "note": "a // b" }',
    "package.json": '{"name": "root", "workspaces": ["pkgs/*"], "dependencies": {"express": "1"}}',
    "pkgs/ui/package.json": '{"name": "@acme/ui"}',
    "pnpm-workspace.yaml": "packages:\n  - 'web'\n  - '!pkgs/old'\nother:\n  - x\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("repo")
    for name, text in FILES.items():
        p = top / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(top)


@pytest.fixture(scope="module")
def result(spark, root):
    return analyze.analyze(spark, root)


def test_crawl_and_registry(spark, root):
    found = code.crawl(spark, root)
    want = sorted(p for p in FILES if p.endswith((".js", ".ts", ".tsx")) and "node_modules" not in p)
    assert sorted(r["canonical_path"] for r in found.collect()) == want
    reg = {r["canonical_path"]: r["node_id"] for r in code.registry(found).collect()}
    assert reg == {p: i for i, p in enumerate(want)}
    again = code.registry_from_json(code.registry_json(code.registry(found)))
    assert {r["canonical_path"]: r["node_id"] for r in again.collect()} == reg


def test_extraction():
    got = code.extract(FILES["services/studentService.js"])
    assert dict(got["exports"]).keys() == {"findAll", "findById"} and got["raw_imports"] == []
    got = code.extract("import A, { b as c } from 'x'\nimport * as ns from \"y\"\nexport { z } from './z'\nconst {p: q, r} = require('./w')\nfoo('a,b', `t${1}u`, bar.baz, [1, (2)])\nnew Thing(arg)\nimport('./lazy')\n")
    assert [(i["path"], i["line"]) for i in got["raw_imports"]] == [("x", 1), ("y", 2), ("./z", 3), ("./w", 4), ("./lazy", 7)]
    assert got["calls"] == [{"callee": "foo", "line": 5, "args": [{"kind": "string", "value": "a,b"}, {"kind": "string", "value": "t*u"}, {"kind": "identifier", "value": "bar.baz"}, {"kind": "other", "value": ""}]}]
    assert dict(got["bindings"])["y"] == "ns" and dict(got["names"])["./w"] == ["q", "r"] and {"Thing", "foo"} <= set(got["callsites"]) and "arg" in got["ref_usages"]


def test_extraction_knows_strings_comments_templates_and_patterns():
    got = code.extract('const a = "image/*"; import x from "./x"; const b = "*/*"; // import y from "./y"\nconst re = /["\'`]\\/\\*/g; import z from "./z"\n`${require("./in")} import q from "./q"`')
    assert [(i["path"], i["line"]) for i in got["raw_imports"]] == [("./x", 1), ("./z", 2), ("./in", 3)]
    got = code.extract("export const a = 1, b = {c: 2}\nexport async function* f() {}\nexports.h = async (req) => svc.find(req.query);\nmodule.exports = { findAll, k: v, m() {} }\nexport class C {}\nexport default d")
    assert dict(got["exports"]) == {"a": 1, "b": 1, "f": 2, "h": 3, "findAll": 4, "k": 4} and {"findAll", "v", "req"} <= set(got["ref_usages"]) and set(got["callsites"]) == {"svc", "find"}
    got = code.extract('a.b.c("x"); this.y("z"); class K { m(p) { go(`q`) } }\nconst { s, t } = props; useQuery<User>("/u"); emitter?.on("e.f", cb)\nconst el = <p className="a">Don\'t /* x</p>;\nfn(({ pa, pb }) => pa, v[i]);')
    assert [(c["callee"], c["line"]) for c in got["calls"]] == [("go", 1), ("useQuery", 2), ("emitter.on", 2)]
    assert got["ref_usages"] == ["cb"]
    assert code.extract("")["raw_imports"] == [] and code.extract("`${`${'")["calls"] == []


def test_parse_of_three_files_and_their_dead_import(spark):
    texts = {"src/controllers/studentController.js": "\nconst studentService = require('../services/studentService');\nconst logger = require('../config/logger');\n\nexports.getAll = async (req, res) => {\n    const students = await studentService.findAll(req.query);\n    res.json(students);\n};\n", "src/services/studentService.js": "\nconst findAll = async (query) => {\n    return [];\n};\nconst findById = async (id) => {\n    return null;\n};\nmodule.exports = { findAll, findById };\n", "src/config/logger.js": "\nconst winston = require('winston');\nmodule.exports = winston.createLogger({});\n"}
    files = spark.createDataFrame(list(texts.items()), "canonical_path string, source string")
    reg = spark.createDataFrame([(i, p) for i, p in enumerate(texts)], "node_id long, canonical_path string")
    raw = analyze.raw_edges(code.extracted(files), reg, spark.createDataFrame([], "scope string, alias string, dir string, ord int"), spark.createDataFrame([], "package string, dir string"))
    got = {(r["source_id"], r["target_id"]): r for r in raw.collect()}
    assert set(got) == {(0, 1), (0, 2)} and not got[0, 1]["is_dead_import"] and {"findAll", "findById"} & set(got[0, 1]["called_names"]) and got[0, 2]["is_dead_import"]


def test_configuration(spark, root):
    texts = code.decoded(spark.createDataFrame([(p, bytearray(FILES[p].encode())) for p in ("web/tsconfig.json", "package.json", "pkgs/ui/package.json", "pnpm-workspace.yaml")], "canonical_path string, content binary"))
    a = code.path_aliases(texts.where("canonical_path like '%tsconfig.json'")).collect()
    assert [(r["scope"], r["alias"], r["dir"]) for r in a] == [("web", "@", "web/src")]
    w = code.workspace_packages(texts.where("canonical_path like '%package.json'"), texts.where("canonical_path like '%.yaml'")).collect()
    assert [(r["package"], r["dir"]) for r in w] == [("@acme/ui", "pkgs/ui")]
    assert code.paradigm(texts.where("canonical_path = 'package.json'")).first()["paradigm"] == "WEB_API_NODEJS_CJS"
    assert code.module_system(code.crawl(spark, root)).first()["module_system"] == "commonjs"
    assert json.loads(code.strip_jsonc('{"a": "//x", /* c */ "b": [1,], // d\n}')) == {"a": "//x", "b": [1]}
    assert code.pnpm_globs(FILES["pnpm-workspace.yaml"]) == ["web"]


def test_edges(result):
    got = {(r["source"], r["target"]): r for r in result.edges.collect()}
    assert ("controllers/studentController.js", "services/studentService.js") in got
    assert ("web/app/students/page.tsx", "web/src/api.ts") in got and got["web/app/students/page.tsx", "web/src/components/Card.tsx"]["type"] == "RENDERS"
    assert got["web/src/api.ts", "routes/studentRoutes.js"]["type"] == "CALLS_API"
    assert got["web/app/layout.tsx", "web/app/students/page.tsx"]["is_synthetic"]
    assert not any("node_modules" in s or "nope" in t for s, t in got)


def test_dead_imports(spark, root):
    files = code.extracted(code.crawl(spark, root))
    reg = code.registry(code.crawl(spark, root))
    none = spark.createDataFrame([], "scope string, alias string, dir string, ord int")
    raw = analyze.raw_edges(files, reg, none, spark.createDataFrame([], "package string, dir string"))
    p = {r["node_id"]: r["canonical_path"] for r in reg.collect()}
    got = {(p[r["source_id"]], p[r["target_id"]]): r for r in raw.collect()}
    service = got["controllers/studentController.js", "services/studentService.js"]
    assert not service["is_dead_import"] and {"findAll", "findById"} <= set(service["called_names"])
    assert got["controllers/studentController.js", "config/logger.js"]["is_dead_import"]


def test_nodes_clusters_and_entries(result):
    nodes = result.nodes.collect()
    apps = [n for n in nodes]
    assert len({n["canonical_path"] for n in apps}) == len(apps) == 10
    assert next(n for n in nodes if n["canonical_path"] == "scripts/seed.js")["cluster_id"].startswith("DevOps")
    assert {n["cluster_id"] for n in nodes} == {c["cluster_id"] for c in result.clusters.collect()}
    entries = {r["file"]: r for r in result.entries.collect()}
    assert entries["web/app/students/page.tsx"]["url"] == "/students" and entries["server.js"]["kind"] == "server"
    c = result.coverage.first()
    assert c["reached"] + c["unreached_count"] == c["total"] == 10


def test_analysis_with_vectors_adds_semantic_edges(spark, root):
    def embed(texts):
        return [[float(t.count("a") + 1), float(t.count("e")), float(len(t) % 7)] for t in texts]

    got = analyze.analyze(spark, root, embed=embed)
    nodes = {n["canonical_path"]: n["cluster_id"] for n in got.nodes.collect()}
    assert len(nodes) == 10 and all(nodes.values())
    placed = [e for e in got.edges.collect() if e["type"] == "SEMANTIC_SIMILARITY"]
    assert all(e["weight"] == 0.2 and e["is_synthetic"] for e in placed)


def test_blueprint_and_snapshot_round_trip(spark, result, tmp_path):
    doc = sinks.blueprint(result.nodes.withColumn("id", F.col("canonical_path")), result.edges, result.clusters.withColumn("id", F.col("cluster_id")), result.entries)
    text = doc.first()["document"]
    (tmp_path / "b.json").write_text(text)
    back = sinks.read_blueprint(spark, str(tmp_path / "b.json")).first()
    assert back["metadata"]["max_cluster_size"] == max(c["size"] for c in result.clusters.collect())
    assert back["metadata"]["total_nodes_indexed"] == 10 == len(back["nodes"]) and back["schema_version"] == "2.2"
    root = f"{tmp_path}/snap"
    for s in ("s1", "s2", "s2"):  # a snapshot stored twice is there once
        counts = sinks.persist_snapshot(result.nodes, result.edges, s, root, "p", None, f"2024-01-0{s[1]} 00:00:00").first()
    assert counts["nodes_count"] == 10 and counts["edges_count"] == result.edges.count()
    assert [tuple(r) for r in sinks.current_snapshot(spark, root).collect()] == [("p", "s2")]
    assert sinks.snapshots(spark, root).count() == 2
    n, e = sinks.snapshot(spark, root, "s1")
    assert n.count() == 10 and e.count() == counts["edges_count"] and len(n.inputFiles()) < len(versions.Versions(spark, root).read("nodes").inputFiles())
    paths = {r["node_id"]: r["canonical_path"] for r in n.collect()}
    assert sorted((paths[r["source_id"]], paths[r["target_id"]]) for r in e.collect()) == sorted((r["source"], r["target"]) for r in result.edges.collect())


def test_documents_of_any_size_are_put_together_from_fragments(spark, result, tmp_path):
    nodes, clusters = result.nodes.withColumn("id", F.col("canonical_path")), result.clusters.withColumn("id", F.col("cluster_id"))
    path = f"{tmp_path}/b.json"
    for _ in range(2):  # a second run replaces the first
        sinks.write_blueprint(nodes, result.edges, clusters, result.entries, path)
    with open(path) as f:
        got = json.load(f)
    assert got == json.loads(sinks.blueprint(nodes, result.edges, clusters, result.entries).first()["document"])
    assert len(sinks.read_blueprint(spark, path).first()["nodes"]) == 10
    ids = code.registry(nodes.select("canonical_path"))
    plain = nodes.drop("node_id").join(ids, "canonical_path")
    named = result.edges.join(ids.toDF("source_id", "source"), "source").join(ids.toDF("target_id", "target"), "target")
    sinks.write_cluster_report(analytics.cluster_report(plain, named), f"{tmp_path}/c.json")
    with open(f"{tmp_path}/c.json") as f:
        assert [c["cluster_id"] for c in json.load(f)["clusters"]] == sorted({r["cluster_id"] for r in plain.collect()})
    sinks.write_document({}, {"none": (nodes.where("false"), ["canonical_path"])}, spark, f"{tmp_path}/d.json")
    with open(f"{tmp_path}/d.json") as f:
        assert json.load(f) == {"none": []}
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")) == ["b.json", "c.json", "d.json"]


def test_archives_and_previews(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name in ("a/b.js", "node_modules/c.js", "../evil.js", "d/", "vendor/x.js", "a\\target\\y.js", "a\\z.js"):
            z.writestr(name, "x")
    got = code.zip_entries(spark.createDataFrame([(bytearray(raw.getvalue()),)], "content binary"))
    assert sorted(r["canonical_path"] for r in got.collect()) == ["a/b.js", "a/z.js"]
    named = code.zip_entries(spark.createDataFrame([("x.ZIP", bytearray(raw.getvalue())), ("x.tar", bytearray(b"no"))], "name string, content binary"))
    assert named.count() == 2
    outside = spark.createDataFrame([(p, bytearray(b"x")) for p in ("/etc/p", "C:/x", "\\\\h", "../a", "a/../../b", "a/../b", "")], "canonical_path string, content binary")
    assert [r["canonical_path"] for r in code.preview(outside).collect()] == ["a/../b"]
    p = {r["canonical_path"]: r for r in code.preview(spark.createDataFrame([("t", bytearray(b"abc")), ("b", bytearray(b"a\x00")), ("l", bytearray(b"x" * (3 << 20)))], "canonical_path string, content binary")).collect()}
    assert (p["t"]["is_binary"], p["b"]["is_binary"], p["l"]["truncated"], len(p["l"]["head"])) == (False, True, True, 2 << 20) and p["b"]["head"] == b"" and not p["b"]["truncated"]
    snaps = spark.createDataFrame([("s1", "a", bytearray(gzip.compress(b"{}"))), ("s2", "b", None), ("s3", "c", None)], "snapshot_id string, commit_sha string, compressed_map binary")
    files = spark.createDataFrame([("b", "[]")], "commit_sha string, document string")
    assert {r["snapshot_id"]: r["document"] for r in code.snapshot_document(files, snaps).collect()} == {"s1": "{}", "s2": "[]"}


def test_extraction_is_dealt_over_tasks_and_done_once(spark, tmp_path):
    from lattica.plans import registry

    f = spark.range(100).coalesce(1).selectExpr("concat('a/', id, '.ts') as canonical_path", "concat('export const e', id, ' = 1;') as source")
    tasks = code.extracted(f).withColumn("task", F.spark_partition_id()).agg(F.countDistinct("task").alias("t"), F.count("*").alias("n")).first()
    assert (tasks["t"], tasks["n"]) == (4, 100)
    rows = [(i, f"name {i}", "ECONOMY X", "Brand#1", i % 7, 1.0) for i in range(1, 13)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    for name in ("dead_imports", "server_routes"):
        plan = registry.load()[0][name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan  # it reads what was extracted once


def test_small_blame_texts_share_a_batch(spark):
    import types

    import pyarrow as pa

    from lattica.sources import git

    run = git._parsed(types.SimpleNamespace(sparkSession=spark, mapInArrow=lambda run, ddl: run), git.parse_blame, ["line", "author", "email"], [pa.int32(), pa.string(), pa.string()], "line int, author string, email string")
    text = b"author u1\nauthor-mail <u1@x.org>\n\tlet x = 1;\n"
    out = list(run(iter([pa.RecordBatch.from_pydict({"key": [f"f{i}" for i in range(100)] + ["none"], "content": [text] * 100 + [None]})])))
    assert len(out) == 1 and out[0].num_rows == 100 and out[0].to_pylist()[7] == {"key": "f7", "line": 1, "author": "u1", "email": "u1@x.org"}
