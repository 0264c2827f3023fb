"""Reading a code base: crawl, configuration files and extraction of imports, exports and calls.

Files are read with Spark's binaryFile source from any store. What regular expressions can say is
said with Spark functions; scanners with state (comments, brackets, template literals) run as
Arrow batches in mapInArrow.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica import schemas as S
from lattica.functions import scalar as fn
from lattica.session import fan_out, ship
from lattica.sources import tree
from lattica.sources.scan import extract

PREVIEW_BYTES, SNIFF_BYTES = 2 << 20, 8 << 10
EXTRACT_BYTES = 16 << 20  # of files, by Catalyst's estimate, that one task extracts


def crawl(spark: SparkSession, root: str) -> DataFrame:
    """canonical_path, source: the source files below root, outside the skipped directories.

    Skipped directories are neither listed nor read (`lattica.sources.tree`). Suffixes are compared in
    lower case; bytes that aren't UTF-8 become replacement characters."""
    ship(spark)
    tree.register(spark)
    return spark.read.format("code_tree").load(root)


def configurations(spark: SparkSession, root: str) -> DataFrame:
    """canonical_path, source: compiler and workspace configuration files outside the skipped directories."""
    ship(spark)
    tree.register(spark)
    return spark.read.format("code_tree").option("names", ",".join(S.CONFIGURATIONS)).load(root)


def decoded(files: DataFrame) -> DataFrame:
    """files with source, the text of content; wrong bytes are replaced."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [(c or b"").decode("utf-8", "replace") for c in b.column(b.schema.get_field_index("content")).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("canonical_path")), pa.array(text, pa.string())], ["canonical_path", "source"])

    return files.select("canonical_path", "content").mapInArrow(run, S.FILES)


def registry(files: DataFrame) -> DataFrame:
    """node_id, canonical_path: dense ids in path order.

    Ids are given in two steps, a range per partition and an offset, so no single task sorts everything."""
    paths = files.select("canonical_path").distinct().repartitionByRange(F.col("canonical_path")).sortWithinPartitions("canonical_path")
    from lattica.session import written

    marked = written(paths.withColumn("part", F.spark_partition_id()), "registry")
    sizes = marked.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("canonical_path")) - 1
    return marked.withColumn("rank", rank).join(F.broadcast(sizes.select("part", "before")), "part").select((F.col("before") + F.col("rank")).alias("node_id"), "canonical_path")


def registry_json(reg: DataFrame) -> DataFrame:
    """One row: the registry as a JSON object from path to id."""
    return reg.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("canonical_path", "node_id"))))).alias("value"))


def registry_from_json(text: DataFrame) -> DataFrame:
    return text.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("canonical_path", "node_id")).select("node_id", "canonical_path")


def strip_jsonc(text: str) -> str:
    """JSON without comments; strings stay as they are."""
    out = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m.group(1) or "", text, flags=re.DOTALL)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m.group(1) or "", out, flags=re.DOTALL)


def _json_udf(f, ddl: str):
    @F.pandas_udf(ddl)
    def run(x: pd.Series) -> pd.Series:
        return x.map(f)

    return run


def path_aliases(configs: DataFrame) -> DataFrame:
    """scope, alias, dir, ord: path aliases of compiler configuration files.

    configs: canonical_path, source. Only a path's first target counts; broken files have none."""
    ship(configs.sparkSession)
    plain = _json_udf(strip_jsonc, "string")
    spec = F.from_json(plain("source"), "struct<compilerOptions:struct<baseUrl:string,paths:map<string,array<string>>>>")
    scope = fn.parent(F.col("canonical_path"))
    rows = configs.select(F.col("canonical_path"), scope.alias("scope"), F.posexplode(F.map_entries(spec["compilerOptions"]["paths"])).alias("ord", "e"))
    target = F.regexp_replace(F.get("e.value", F.lit(0)), r"[/*]+$", "")
    full = F.when(F.col("scope") == ".", target).otherwise(F.concat_ws("/", "scope", target))
    from lattica.operators.resolve import normalized

    return rows.where(F.size("e.value") > 0).select("scope", F.regexp_replace("e.key", r"[/*]+$", "").alias("alias"), normalized(full).alias("dir"), "ord")


def pnpm_globs(text: str) -> list[str]:
    """The globs of the packages list of a workspace file, without negations."""
    block = re.search(r"(?m)^packages:[^\n]*\n((?:[ \t]*(?:-[^\n]*|#[^\n]*)?\n?)*)", text + "\n")
    items = re.findall(r"(?m)^\s*-\s*['\"]?([^'\"#\n]+?)['\"]?\s*(?:#.*)?$", block.group(1)) if block else []
    return [i for i in items if not i.startswith("!")]


def workspace_packages(manifests: DataFrame, workspaces: DataFrame) -> DataFrame:
    """package, dir of the workspace members.

    manifests: canonical_path, source of package.json files; workspaces: the same of pnpm-workspace.yaml files."""
    ship(manifests.sparkSession)

    def globs(text: str) -> list[str]:
        try:
            w = json.loads(text).get("workspaces") or []
        except (ValueError, AttributeError):
            return []
        return [g for g in (w.get("packages") or [] if isinstance(w, dict) else w) if isinstance(g, str)]

    own = manifests.select(F.explode(_json_udf(globs, "array<string>")("source")).alias("glob"), fn.parent(F.col("canonical_path")).alias("root"))
    pnpm = workspaces.select(F.explode(_json_udf(pnpm_globs, "array<string>")("source")).alias("glob"), fn.parent(F.col("canonical_path")).alias("root"))
    full = own.unionByName(pnpm).withColumn("glob", F.when(F.col("root") == ".", F.col("glob")).otherwise(F.concat_ws("/", "root", "glob"))).withColumn("glob", F.regexp_replace("glob", "/+$", ""))
    literal = F.regexp_replace("glob", r"(^|/)[^/*]*\*.*$", "")  # what stands before the first segment with a wildcard
    rule = full.select(F.when(literal == "", ".").otherwise(literal).alias("above"), F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("glob", r"[.+()|^$]", r"\\$0"), r"\*\*", "\u0001"), r"\*", "[^/]+"), "\u0001", ".+"), F.lit("$")).alias("rule")).distinct()
    dirs = manifests.select(fn.parent(F.col("canonical_path")).alias("dir"), F.get_json_object("source", "$.name").alias("package")).where("package is not null")
    # a rule meets the directories at and below its literal part by equality, and they are tested against its pattern
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    known = dirs.withColumn("above", F.explode(F.array_distinct(F.concat(F.array(F.lit(".")), ups))))
    return known.join(rule, "above").where(F.expr("dir rlike rule")).groupBy("package").agg(F.min("dir").alias("dir"))


def inside(path):
    """Whether a path is relative and stays below its root."""
    parts = F.filter(F.split(fn.posix(path), "/"), lambda x: (x != "") & (x != "."))
    step = lambda s, x: F.struct((s["depth"] + F.when(x == "..", -1).otherwise(1)).alias("depth"), F.least(s["least"], s["depth"] + F.when(x == "..", -1).otherwise(1)).alias("least"))
    least = F.aggregate(parts, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")), step)["least"]
    return F.coalesce(~path.rlike(r"^([/\\\\]|[A-Za-z]:)") & (F.trim(path) != "") & (least >= 0), F.lit(False))


def preview(files: DataFrame, most: int = PREVIEW_BYTES, sniff: int = SNIFF_BYTES) -> DataFrame:
    """canonical_path, bytes, truncated, is_binary, head of files (content); absolute and escaping paths are left out.

    A file with a zero byte among its first `sniff` bytes is binary: it has no head and isn't truncated."""
    size = F.octet_length("content")
    binary = F.contains(F.substring("content", 1, sniff), F.lit(b"\x00"))
    kept = files.where(inside(F.col("canonical_path")))
    return kept.select("canonical_path", size.cast("long").alias("bytes"), ((size > most) & ~binary).alias("truncated"), binary.alias("is_binary"), F.when(binary, F.lit(b"")).otherwise(F.substring("content", 1, most)).alias("head"))


EXTRACTED = "canonical_path STRING, raw_imports ARRAY<STRUCT<path:STRING,line:INT>>, exports MAP<STRING,INT>, callsites ARRAY<STRING>, ref_usages ARRAY<STRING>, calls ARRAY<STRUCT<callee:STRING,line:INT,args:ARRAY<STRUCT<kind:STRING,value:STRING>>>>, bindings MAP<STRING,STRING>, names MAP<STRING,ARRAY<STRING>>, summary STRING"


def extracted(files: DataFrame) -> DataFrame:
    """What each file imports, exports, calls and names; files: canonical_path, source.

    Scanning costs far more than reading, so files are dealt over tasks first. Who reads the result more
    than once should write it."""
    ship(files.sparkSession)
    arg = pa.struct([("kind", pa.string()), ("value", pa.string())])
    types = {"raw_imports": pa.list_(pa.struct([("path", pa.string()), ("line", pa.int32())])), "exports": pa.map_(pa.string(), pa.int32()), "callsites": pa.list_(pa.string()), "ref_usages": pa.list_(pa.string()), "calls": pa.list_(pa.struct([("callee", pa.string()), ("line", pa.int32()), ("args", pa.list_(arg))])), "bindings": pa.map_(pa.string(), pa.string()), "names": pa.map_(pa.string(), pa.list_(pa.string()))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [extract(s or "") for s in b["source"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["canonical_path"], *(pa.array([f[k] for f in found], t) for k, t in types.items()), b["summary"]], ["canonical_path", *types, "summary"])

    dealt = files.select("canonical_path", "source").repartition(fan_out(files, EXTRACT_BYTES), "canonical_path")
    rows = dealt.select("canonical_path", "source", F.substring(fn.preprocess(F.col("source"), F.col("canonical_path")), 1, 300).alias("summary"))
    return rows.mapInArrow(run, EXTRACTED)


# What a package is taken for, by the first dependency found.
_PARADIGMS = ((("next",), "WEB_FRAMEWORK_NEXTJS"), (("react",), "WEB_FRAMEWORK_REACT"), (("vue",), "WEB_FRAMEWORK_VUE"), (("express", "fastify", "koa", "hapi"), "WEB_API_NODEJS"), (("nestjs", "@nestjs/core"), "WEB_FRAMEWORK_NESTJS"))


def paradigm(manifest: DataFrame) -> DataFrame:
    """paradigm of a package.json (source): the first framework that it depends on, else its module type."""
    p = F.from_json("source", "struct<type:string,dependencies:map<string,string>,devDependencies:map<string,string>>")
    none = F.array().cast("array<string>")
    keys = F.concat(F.coalesce(F.map_keys(p["dependencies"]), none), F.coalesce(F.map_keys(p["devDependencies"]), none))
    has = lambda *names: F.arrays_overlap(keys, F.array(*(F.lit(n) for n in names)))
    esm = F.coalesce(p["type"], F.lit("commonjs")) == "module"
    kind = F.when(esm, "PURE_LIBRARY_ESM").otherwise("PURE_LIBRARY_CJS")
    for names, label in reversed(_PARADIGMS):
        shown = F.when(esm, f"{label}_ESM").otherwise(f"{label}_CJS") if label == "WEB_API_NODEJS" else F.lit(label)
        kind = F.when(has(*names), shown).otherwise(kind)
    return manifest.select(F.when(p.isNull() | F.get_json_object("source", "$").isNull(), "UNKNOWN").otherwise(kind).alias("paradigm"))


def module_system(files: DataFrame) -> DataFrame:
    """commonjs, esm, mixed or unknown, from the first 20 scripts by path."""
    some = files.where(F.col("canonical_path").rlike(r"\.(js|mjs|cjs)$")).orderBy("canonical_path").limit(20)
    hits = some.agg(F.count_if(F.col("source").rlike(r"\brequire\s*\(")).alias("c"), F.count_if(F.col("source").rlike(r"\b(import|export)\s+")).alias("e"))
    return hits.select(F.when((F.col("c") > 0) & (F.col("e") > 0), "mixed").when(F.col("c") > 0, "commonjs").when(F.col("e") > 0, "esm").otherwise("unknown").alias("module_system"))


def zip_entries(archives: DataFrame) -> DataFrame:
    """canonical_path, content of the files inside zip archives (content, and name if there is one).

    Names that don't end in .zip are left out, and so are skipped directories and escaping entries."""
    ship(archives.sparkSession)
    if "name" in archives.columns:
        archives = archives.where(F.lower("name").endswith(".zip"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import zipfile

        for b in batches:
            for raw in b["content"].to_pylist():
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for entry in z.namelist():
                        name = entry.replace("\\", "/")
                        parts = name.split("/")
                        if not name.endswith("/") and ".." not in parts and not name.startswith("/") and not set(parts) & set(S.SKIPPED_IN_ZIP):
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([z.read(entry)], pa.binary())], ["canonical_path", "content"])

    return archives.select("content").mapInArrow(run, "canonical_path string, content binary")


def gunzipped(rows: DataFrame, column: str) -> DataFrame:
    """rows with `document`, the text inside a gzip column."""
    import gzip

    return rows.withColumn("document", _json_udf(lambda x: None if x is None else gzip.decompress(bytes(x)).decode(), "string")(column))


def snapshot_document(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """snapshot_id, document: the file of a commit if there is one, else the stored archive; missing ones drop out."""
    stored = gunzipped(snapshots, "compressed_map").select("snapshot_id", "commit_sha", F.col("document").alias("stored"))
    return stored.join(files.select("commit_sha", F.col("document").alias("file")), "commit_sha", "left").select("snapshot_id", F.coalesce("file", "stored").alias("document")).where("document is not null")
