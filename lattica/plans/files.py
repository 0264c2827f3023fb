"""Queries on paths, urls, texts and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica import schemas as S
from lattica.functions import scalar as fn
from lattica.operators import domains, infer, resolve
from lattica.plans import analyze
from lattica.plans import views as v
from lattica.plans.registry import query
from lattica.session import written
from lattica.sources import code


def _tok(x: str, least: int, stop: bool) -> str:
    """SQL for the distinct words of a path."""
    camel = f"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    out = f"list_distinct(list_transform(list_filter(regexp_extract_all({camel}, '[a-zA-Z][a-zA-Z0-9]*'), lambda w: length(w) >= {least}), lambda w: lower(w)))"
    words = ", ".join(f"'{w}'" for w in sorted(set(S.STOPWORDS)))
    return f"list_filter({out}, lambda w: w NOT IN ({words}))" if stop else out


def _strings(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_MIXED = "'lib/' || replace(p_type, ' ', '') || 'Service/' || replace(p_name, ' ', 'HTTPAdapter') || '.controller.ts'"


def _mixed():
    return F.concat(F.lit("lib/"), F.regexp_replace("p_type", " ", ""), F.lit("Service/"), F.regexp_replace("p_name", " ", "HTTPAdapter"), F.lit(".controller.ts"))


@query(f"SELECT node_id, array_to_string(list_sort({_tok(_MIXED, 3, True)}), ',') AS tokens FROM paths", "paths")
def tokenize_paths(t):
    return v.paths(t).select("node_id", F.array_join(F.array_sort(fn.tokenize(_mixed())), ",").alias("tokens"))


@query(f", w AS (SELECT unnest({_tok('canonical_path', 4, False)}) AS token FROM paths) SELECT token, count(*)::BIGINT AS files FROM w GROUP BY 1 HAVING count(*) / (SELECT count(*) FROM paths) >= 0.35", "paths")
def layer_words(t):
    return domains.layer_words(v.paths(t).select("node_id", fn.camel_tokens(F.col("canonical_path"), 4).alias("tokens")))


_KNOWN = _strings(sorted({w for ws in S.LEXICON.values() for w in ws.split()}))
_CLASSES = f", w AS (SELECT token, count(*)::BIGINT AS files FROM (SELECT unnest({_tok('canonical_path', 3, True)}) AS token FROM paths) GROUP BY 1), n AS (SELECT count(*) AS n FROM paths) "


@query(_CLASSES + "SELECT token, files FROM w, n WHERE files / n > 0.6", "paths")
def common_tokens(t):
    c = domains.token_classes(v.paths(t).select("node_id", fn.tokenize(F.col("canonical_path")).alias("tokens")))
    return c.where("kind = 'common'").select("token", "files")


@query(_CLASSES + f"SELECT token, files FROM w, n WHERE files / n <= 0.5 AND files >= 3 AND length(token) >= 4 AND token NOT IN ({_KNOWN}) ORDER BY files DESC, token DESC LIMIT 12", "paths")
def emergent_tokens(t):
    c = domains.token_classes(v.paths(t).select("node_id", fn.tokenize(F.col("canonical_path")).alias("tokens")))
    return c.where("kind = 'emergent'").select("token", "files")


def _case(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} IN ({_strings(w.split())}) THEN {k}" for k, w in S.TIERS.items()) + " END"


_LAYERED = "'src/' || CASE node_id % 6 WHEN 0 THEN 'models/' ELSE '' END || replace(p_name, ' ', '-') || CASE node_id % 5 WHEN 0 THEN '.controller' WHEN 1 THEN '_service' WHEN 2 THEN '-routes' WHEN 3 THEN '' ELSE '.repo' END || '.js'"


def _layered():
    k = F.col("node_id")
    tail = F.when(k % 5 == 0, ".controller").when(k % 5 == 1, "_service").when(k % 5 == 2, "-routes").when(k % 5 == 3, "").otherwise(".repo")
    return F.concat(F.lit("src/"), F.when(k % 6 == 0, "models/").otherwise(""), F.regexp_replace("p_name", " ", "-"), tail, F.lit(".js"))


@query(f", l AS (SELECT node_id, {_LAYERED} AS p FROM paths), s AS (SELECT node_id, string_split(translate(lower(regexp_replace(regexp_extract(p, '[^/]*$'), '\\.[^.]*$', '')), '-_', '..'), '.') AS parts, string_split(p, '/')[-2] AS dir FROM l) SELECT node_id, coalesce(list_filter(list_transform(parts, lambda x: {_case('x')}), lambda y: y IS NOT NULL)[1], {_case('dir')})::INTEGER AS tier FROM s", "paths")
def file_layer(t):
    return v.paths(t).select("node_id", fn.file_layer(_layered()).alias("tier"))


def _tier():
    first = F.split("p_type", " ")[0]
    return F.when(first == "ECONOMY", 0).when(first == "LARGE", 1).when(first == "MEDIUM", 2).when(first == "PROMO", 3).when(first == "SMALL", 4)


_TIERS = "CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'PROMO' THEN 3 WHEN 'SMALL' THEN 4 END"


_TIERED = f", f AS (SELECT node_id, {_TIERS} AS tier, unnest(list_distinct(string_split(p_name, ' '))) AS token FROM paths)"


def _tiered(t):
    return v.paths(t).select("node_id", _tier().alias("tier"), F.array_distinct(F.split("p_name", " ")).alias("tokens"))


@query(_TIERED + " SELECT a.node_id AS source_id, b.node_id AS target_id, string_agg(DISTINCT a.token, ',' ORDER BY a.token) AS called_names FROM f a JOIN f b ON a.token = b.token AND a.tier < b.tier GROUP BY 1, 2", "paths")
def naming_edges(t):
    """The links by shared words, pair by pair."""
    return infer.naming_edges(_tiered(t), show=lambda names: F.array_join(names, ","))


@query(_TIERED + ", g AS (SELECT token, tier, count(*) AS n FROM f WHERE tier IS NOT NULL GROUP BY 1, 2) SELECT a.token, a.tier AS source_tier, b.tier AS target_tier, a.n AS sources, b.n AS targets, (a.n * b.n)::BIGINT AS links FROM g a JOIN g b ON a.token = b.token AND a.tier < b.tier", "paths")
def naming_groups(t):
    """The links by shared words as groups of files by word and tier."""
    return infer.naming_groups(_tiered(t))


@query(_TIERED + " SELECT a.node_id AS source_id, b.node_id AS target_id, string_agg(DISTINCT a.token, ',' ORDER BY a.token) AS called_names FROM f a JOIN f b ON a.token = b.token AND a.tier < b.tier GROUP BY 1, 2", "paths")
def naming_pairs(t):
    """The same rows as naming_edges."""
    return naming_edges(t)


@query(", b AS (SELECT node_id, string_split(canonical_path, '/') AS p FROM paths) SELECT node_id, CASE WHEN len(p) <= 1 THEN regexp_replace(p[1], '\\.[^.]*$', '') ELSE array_to_string(p[1:2], '/') END AS two, array_to_string(p[1:4], '/') AS four FROM b", "paths")
def canonical_bucket(t):
    p = F.col("canonical_path")
    return v.paths(t).select("node_id", fn.canonical_bucket(p).alias("two"), fn.canonical_bucket(p, 4).alias("four"))


_DEEP = """, d2 AS (SELECT node_id, canonical_path, array_to_string(string_split(canonical_path, '/')[1:2], '/') AS bucket FROM paths),
d3 AS (SELECT node_id, canonical_path, CASE WHEN count(*) OVER w > 150 AND min(x) OVER w <> max(x) OVER w THEN x ELSE bucket END AS bucket FROM (SELECT *, array_to_string(string_split(canonical_path, '/')[1:3], '/') AS x FROM d2) WINDOW w AS (PARTITION BY bucket)),
d4 AS (SELECT node_id, CASE WHEN count(*) OVER w > 150 AND min(x) OVER w <> max(x) OVER w THEN x ELSE bucket END AS bucket FROM (SELECT *, array_to_string(string_split(canonical_path, '/')[1:4], '/') AS x FROM d3) WINDOW w AS (PARTITION BY bucket)) SELECT * FROM d4"""


@query(_DEEP, "paths")
def adaptive_buckets(t):
    from lattica.operators.cluster import adaptive_buckets as run

    return run(v.paths(t))


_DIRS = "regexp_replace(canonical_path, '/[^/]*$', '')"


@query(f", f AS (SELECT node_id, {_DIRS} AS dir FROM paths) SELECT a.node_id AS source_id, b.node_id AS target_id FROM f a JOIN f b ON a.dir = b.dir AND a.node_id <> b.node_id", "paths")
def sibling_edges(t):
    return infer.sibling_edges(v.paths(t).select("node_id", fn.parent(F.col("canonical_path")).alias("dir")))


@query(f", l AS (SELECT min(node_id) AS layout_id, array_to_string(string_split(canonical_path, '/')[1:(2 + node_id % 2)], '/') AS dir FROM paths GROUP BY 2), f AS (SELECT node_id, string_split({_DIRS}, '/') AS d FROM paths), u AS (SELECT node_id, unnest(range(1, len(d))) AS n, d FROM f), c AS (SELECT u.node_id, arg_max(layout_id, n) AS layout_id FROM u JOIN l ON array_to_string(d[1:n], '/') = l.dir GROUP BY 1) SELECT layout_id AS source_id, node_id AS target_id FROM c WHERE layout_id <> node_id", "paths")
def ancestor_layout(t):
    p = F.split("canonical_path", "/")
    l_ = v.paths(t).select("node_id", F.array_join(F.slice(p, F.lit(1), (2 + F.col("node_id") % 2).cast("int")), "/").alias("dir"))
    return infer.layout_edges(v.paths(t).select("node_id", fn.parent(F.col("canonical_path")).alias("dir")), infer.first_of_directory(l_))


_STEMS = _strings(S.ENTRY_STEMS)
_UI = " OR ".join(f"contains(tgt, '{h}')" for h in S.SHARED_UI)
_CLASS = f"""SELECT source_id, target_id, 'app/' || CASE l_linenumber % 3 WHEN 0 THEN 'page.tsx' WHEN 1 THEN 'Layout.tsx' ELSE 'util.ts' END AS src,
CASE l_linenumber % 4 WHEN 0 THEN 'packages/ui/x.tsx' WHEN 1 THEN 'lib/Card.tsx' WHEN 2 THEN 'lib/page.tsx' ELSE 'lib/card.ts' END AS tgt FROM (SELECT l_partkey AS source_id, l_suppkey AS target_id, l_linenumber FROM lineitem)"""


def _classed(t):
    n = F.col("l_linenumber")
    src = F.concat(F.lit("app/"), F.when(n % 3 == 0, "page.tsx").when(n % 3 == 1, "Layout.tsx").otherwise("util.ts"))
    tgt = F.when(n % 4 == 0, "packages/ui/x.tsx").when(n % 4 == 1, "lib/Card.tsx").when(n % 4 == 2, "lib/page.tsx").otherwise("lib/card.ts")
    return t.lineitem.withColumn("kind", fn.edge_class(src, tgt))


@query(f"WITH c AS ({_CLASS}), s AS (SELECT *, lower(regexp_extract(src, '([^/]*)\\.[^.]*$', 1)) AS a, regexp_extract(tgt, '([^/]*)\\.[^.]*$', 1) AS b FROM c) SELECT CASE WHEN {_UI} OR (a IN ({_STEMS}) AND regexp_matches(b, '^[A-Z]') AND lower(b) NOT IN ({_STEMS})) THEN 'RENDERS' ELSE 'BELONGS_TO_DOMAIN' END AS kind, count(*)::BIGINT AS n, count(DISTINCT source_id)::BIGINT AS sources FROM s GROUP BY 1")
def classify_edge(t):
    return _classed(t).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("sources"))


def _sources(t):
    """A script for each part: it imports the next one, and calls something."""
    k = F.col("p_partkey")
    callee = F.when(k % 3 == 0, "dep.run").when(k % 3 == 1, "other").otherwise("hand")
    text = F.concat(F.lit("import dep, { a as b"), k, F.lit(" } from './"), k + 1, F.lit("';\nconst g = \"image/*\"; // import x from './no'\n"), callee, F.lit("('ev."), "p_size", F.lit("', b"), k % 2 * k, F.lit(");\nexport const e"), k, F.lit(" = `t${x}/*`;"))
    return t.part.select(F.concat(F.lit("lib/"), k, F.lit(".ts")).alias("canonical_path"), text.alias("source"))


@query("""SELECT 'lib/' || p_partkey || '.ts' AS canonical_path, './' || (p_partkey + 1) AS import_path, 1 AS import_line, 'e' || p_partkey AS export_name, 4 AS export_line, 'dep' AS binding, 'b' || p_partkey AS named,
CASE p_partkey % 3 WHEN 0 THEN 'dep.run' WHEN 1 THEN 'other' ELSE 'hand' END AS callee, 'ev.' || p_size AS first_string, 3 AS call_line, 'b' || (p_partkey % 2 * p_partkey) AS used FROM part""")
def source_extract(t):
    one = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))  # noqa: E731  (more than one would be wrong)
    x = code.extracted(_sources(t))
    call, imported = one("calls"), one("raw_imports")
    return x.select("canonical_path", imported["path"].alias("import_path"), imported["line"].alias("import_line"), one(F.map_keys("exports")).alias("export_name"), one(F.map_values("exports")).alias("export_line"), one(F.map_values("bindings")).alias("binding"), one(one(F.map_values("names"))).alias("named"), call["callee"].alias("callee"), infer.first_string(call["args"]).alias("first_string"), call["line"].alias("call_line"), one("ref_usages").alias("used"))


@query("SELECT p_partkey AS source_id, p_partkey + 1 AS target_id, NOT (p_partkey % 3 = 0 OR p_partkey % 2 = 1) AS is_dead FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)")
def dead_imports(t):
    registry = t.part.select(F.col("p_partkey").alias("node_id"), F.concat(F.lit("lib/"), "p_partkey", F.lit(".ts")).alias("canonical_path"))
    none = t.spark.createDataFrame([], "scope string, alias string, dir string, ord int")
    raw = analyze.raw_edges(written(code.extracted(_sources(t)), "extracted"), registry, none, t.spark.createDataFrame([], "package string, dir string"))
    return raw.select("source_id", "target_id", F.col("is_dead_import").alias("is_dead"))


def url_sql(x: str) -> str:
    """SQL for normalize_url on text without line ends."""
    u = f"regexp_replace(regexp_replace(trim({x}), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '[?#].*$', '')"
    seg = f"list_transform(list_filter(string_split({u}, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^(\\[.*\\]|:.+|\\*|\\{{.*\\}})$') OR regexp_matches(s, '^[0-9]+$') OR contains(s, '*') THEN '*' ELSE lower(s) END)"
    return f"('/' || array_to_string({seg}, '/'))"


@query(f"SELECT page_id, {url_sql('url')} AS url FROM pages")
def normalize_url(t):
    return t.pages.select("page_id", fn.normalize_url(F.col("url")).alias("url"))


@query(f"SELECT page_id, {url_sql(chr(39) + '/api/' + chr(39) + ' || page_id || ' + chr(39) + '//' + chr(39) + ' || regexp_extract(url, ' + chr(39) + '[^/]*$' + chr(39) + ')')} AS url FROM pages")
def join_url(t):
    return t.pages.select("page_id", fn.join_url(F.concat(F.lit("/api/"), "page_id", F.lit("//")), F.concat(F.lit("/"), F.regexp_extract("url", "[^/]*$", 0))).alias("url"))


@query(f"""WITH u AS (SELECT page_id AS id, {url_sql('url')} AS url FROM pages), s AS (SELECT id, CASE WHEN id % 2 = 0 THEN '/' || string_split(url, '/')[2] || '/*' ELSE '/*/' || string_split(url, '/')[3] END AS url FROM u),
c AS (SELECT url, count(*) AS n, list_filter(string_split(url, '/'), lambda x: x <> '') AS p FROM u GROUP BY 1), r AS (SELECT DISTINCT url, list_filter(string_split(url, '/'), lambda x: x <> '') AS p FROM s WHERE url IS NOT NULL),
m AS (SELECT r.url, sum(c.n) AS clients FROM c JOIN r ON len(c.p) = len(r.p) AND len(list_filter(list_zip(c.p, r.p), lambda z: NOT (z[1] = z[2] OR z[1] = '*' OR z[2] = '*'))) = 0 GROUP BY 1)
SELECT s.id AS server, clients::BIGINT AS clients FROM s JOIN m ON s.url = m.url""")
def url_match_join(t):
    """A route of every page. Pages that share an address or a route are matched once and counted as often as they stand."""
    u = t.pages.select(F.col("page_id").alias("id"), fn.normalize_url(F.col("url")).alias("url"))
    p = F.split("url", "/")
    route = F.when(F.col("id") % 2 == 0, F.concat(F.lit("/"), p[1], F.lit("/*"))).otherwise(F.concat(F.lit("/*/"), F.get(p, F.lit(2))))
    s = u.select("id", route.alias("url")).where("url is not null")
    c = u.groupBy("url").agg(F.count("*").alias("n"))
    pairs = infer.url_pairs(c.select(F.col("url").alias("id"), "url"), s.select(F.col("url").alias("id"), "url").distinct())
    per_route = pairs.join(c.select(F.col("url").alias("client"), "n"), "client").groupBy("url").agg(F.sum("n").alias("clients"))
    return s.join(per_route, "url").select(F.col("id").alias("server"), "clients")


@query("""WITH p AS (SELECT page_id, string_split(url, '/') AS s FROM pages), q AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN ['(' || s[3] || ')', s[4]] WHEN 1 THEN ['[' || s[4] || ']'] WHEN 2 THEN ['@' || s[4], 'Deep', s[4]] ELSE [] END AS d FROM p)
SELECT page_id, CASE WHEN page_id % 7 <> 6 THEN '/' || array_to_string(list_transform(list_filter(d, lambda x: NOT regexp_matches(x, '^\\([^)]+\\)$') AND NOT starts_with(x, '@')), lambda x: CASE WHEN regexp_matches(x, '^\\[.*\\]$') THEN ':' || trim(x, '[].') ELSE x END), '/') END AS url FROM q""")
def page_url(t):
    s = F.split("url", "/")
    k = F.col("page_id")
    d = F.when(k % 4 == 0, F.array(F.concat(F.lit("("), s[2], F.lit(")")), s[3])).when(k % 4 == 1, F.array(F.concat(F.lit("["), s[3], F.lit("]")))).when(k % 4 == 2, F.array(F.concat(F.lit("@"), s[3]), F.lit("Deep"), s[3])).otherwise(F.array().cast("array<string>"))
    name = F.when(k % 7 == 6, "loading.tsx").otherwise("page.tsx")
    return t.pages.select("page_id", fn.page_url(F.array_join(F.concat(F.array(F.lit("web"), F.lit("app")), d, F.array(name)), "/")).alias("url"))


_PKG = "CASE WHEN starts_with(s, '@') THEN array_to_string(string_split(s, '/')[1:2], '/') ELSE split_part(s, '/', 1) END"


@query(f"WITH l AS (SELECT page_id, unnest(list_transform(regexp_extract_all(html, 'href=\"/([^\"]+)\"', 1), lambda x: CASE WHEN length(x) % 3 = 0 THEN '@scope/' || x || '/y' WHEN length(x) % 3 = 1 THEN x || '/sub' ELSE './' || x END)) AS s FROM pages) SELECT page_id, {_PKG} AS package, count(*)::BIGINT AS n FROM l WHERE NOT starts_with(s, '.') AND NOT starts_with(s, '/') GROUP BY 1, 2")
def external_packages(t):
    x = F.transform(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1)), lambda x: F.when(F.length(x) % 3 == 0, F.concat(F.lit("@scope/"), x, F.lit("/y"))).when(F.length(x) % 3 == 1, F.concat(x, F.lit("/sub"))).otherwise(F.concat(F.lit("./"), x)))
    p = t.pages.select("page_id", F.explode(x).alias("s")).select("page_id", fn.package(F.col("s")).alias("package")).where("package is not null")
    return p.groupBy("page_id", "package").agg(F.count("*").alias("n"))


@query("""SELECT 'src/' || lower(p_type) || '/main.js' AS source_path, CASE p_partkey % 5 WHEN 3 THEN '@/' || p_partkey WHEN 4 THEN '@acme/kit/' || p_partkey ELSE './' || p_brand || '/' || p_partkey END AS spec,
CASE p_partkey % 5 WHEN 3 THEN 'src/shared/' || p_partkey || '.ts' WHEN 4 THEN 'pkgs/kit/' || CASE WHEN p_partkey % 2 = 0 THEN 'src/' ELSE '' END || p_partkey || '.tsx'
ELSE 'src/' || lower(p_type) || '/' || p_brand || '/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.ts' ELSE '.js' END END AS resolved FROM part""")
def resolve_probe(t):
    """Relative imports, imports by an alias of the nearest configuration, and imports of a workspace package."""
    k, dir_ = F.col("p_partkey"), F.concat(F.lit("src/"), F.lower("p_type"))
    full = F.concat_ws("/", dir_, "p_brand", k.cast("string"))
    tails = F.when(k % 3 == 0, F.array(F.lit(".ts"), F.lit("/index.ts"))).when(k % 3 == 1, F.array(F.lit("/index.ts"), F.lit("/index.jsx"))).otherwise(F.array(F.lit(".js"), F.lit(".tsx")))
    shared = F.array(F.concat(F.lit("src/shared/"), k, F.lit(".ts")), F.concat(F.lit("web/"), k, F.lit(".ts")))
    kit = F.array_compact(F.array(F.concat(F.lit("pkgs/kit/"), k, F.lit(".tsx")), F.when(k % 2 == 0, F.concat(F.lit("pkgs/kit/src/"), k, F.lit(".tsx")))))
    registry = t.part.select(F.explode(F.when(k % 5 == 3, shared).when(k % 5 == 4, kit).otherwise(F.transform(tails, lambda x: F.concat(full, x)))).alias("canonical_path"))
    spec = F.when(k % 5 == 3, F.concat(F.lit("@/"), k)).when(k % 5 == 4, F.concat(F.lit("@acme/kit/"), k)).otherwise(F.concat(F.lit("./"), "p_brand", F.lit("/"), k.cast("string")))
    imports = t.part.select(F.concat(dir_, F.lit("/main.js")).alias("source_path"), spec.alias("spec"))
    aliases = t.spark.createDataFrame([(".", "@", "web", 0), ("src", "@", "src/shared", 0), ("src", "@/", "web", 1)], "scope string, alias string, dir string, ord int")
    return resolve.resolve(imports, registry, aliases, t.spark.createDataFrame([("@acme/kit", "pkgs/kit")], "package string, dir string"))


@query("""WITH e AS (SELECT user_id, event_type, lower(event_type || ':' || value::INTEGER) AS event FROM events)
SELECT a.event, count(DISTINCT a.user_id)::BIGINT AS emitters, count(DISTINCT b.user_id)::BIGINT AS listeners, count(DISTINCT (a.user_id, b.user_id))::BIGINT AS pairs FROM e a JOIN e b ON a.event = b.event WHERE a.user_id % 2 = 0 AND b.user_id % 2 = 1 GROUP BY 1""".replace("value::INTEGER", "floor(value)::INTEGER"))
def event_join(t):
    name = fn.event_name(F.concat("event_type", F.lit(":"), F.floor("value").cast("int").cast("string")))
    e = t.events.select(F.col("user_id").alias("id"), name.alias("event")).where("event is not null")
    return infer.event_groups(e.where("id % 2 = 0"), e.where("id % 2 = 1")).withColumnRenamed("links", "pairs")


@query(", x AS (SELECT source_id, target_id, edge_type, binding AS label, source_line FROM edges_raw WHERE edge_type = 'CALLS_API'), k AS (SELECT DISTINCT source_id, target_id FROM edges_raw WHERE edge_type = 'RENDERS') SELECT source_id, target_id, edge_type, string_agg(DISTINCT label, ',' ORDER BY label) AS called_names, min(source_line) AS source_line FROM x WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.source_id = x.source_id AND k.target_id = x.target_id) GROUP BY 1, 2, 3", "edges_raw")
def contract_dedupe(t):
    e = v.edges_raw(t)
    links = e.where("edge_type = 'CALLS_API'").select("source_id", "target_id", "edge_type", F.col("binding").alias("label"), F.col("source_line").alias("line"))
    return infer.admitted(links, e.where("edge_type = 'RENDERS'")).withColumn("called_names", F.array_join("called_names", ","))


_DEPS = ["next-auth/react", "@stripe/stripe-js/pure", "lodash", "passport-local", "@clerk/nextjs", "Stripe", "multer", "fuse.js", "@aws-sdk/client-s3/x", "googleapis", "react-admin", "", "resend"]
_EXACT = ", ".join(f"('{p}', '{d}')" for d, ps in S.PACKAGES.items() for p in ps.split())
_PREFIX = ", ".join(f"('{p}', '{d}', {i})" for i, (p, d) in enumerate(S.PACKAGE_PREFIXES))
_LIST = "[" + _strings(_DEPS) + "]"
_DOMAIN = f"""exact(p, d) AS (VALUES {_EXACT}), prefix(p, d, i) AS (VALUES {_PREFIX}), e AS (SELECT event_id, user_id, lower(trim({_LIST}[1 + event_id % {len(_DEPS)}])) AS dep FROM events),
r AS (SELECT *, CASE WHEN starts_with(dep, '@') THEN array_to_string(string_split(dep, '/')[1:2], '/') ELSE split_part(dep, '/', 1) END AS root FROM e),
x AS (SELECT r.*, coalesce(a.d, b.d, (SELECT arg_min(d, i) FROM prefix WHERE starts_with(dep, p))) AS domain FROM r LEFT JOIN exact a ON dep = a.p LEFT JOIN exact b ON root = b.p)"""


def _deps():
    return F.get(F.array(*(F.lit(d) for d in _DEPS)), (F.col("event_id") % len(_DEPS)).cast("int"))


@query(f"WITH {_DOMAIN} SELECT dep, domain, count(*)::BIGINT AS n FROM x GROUP BY 1, 2")
def dep_domain(t):
    return t.events.select(F.lower(_deps()).alias("dep"), fn.package_domain(_deps()).alias("domain")).groupBy("dep", "domain").agg(F.count("*").alias("n"))


@query(f"WITH {_DOMAIN}, c AS (SELECT user_id AS node_id, domain, count(DISTINCT dep)::BIGINT AS votes FROM x WHERE domain IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, rank() OVER (PARTITION BY node_id ORDER BY votes DESC) AS r FROM c) SELECT node_id, any_value(domain) AS domain, max(votes) AS votes FROM k WHERE r = 1 GROUP BY 1 HAVING count(*) = 1")
def dep_seed(t):
    return domains.single_winner(domains.package_votes(t.events.where("event_id is not null").select(F.col("user_id").alias("node_id"), F.lower(_deps()).alias("package")), "node_id"), "node_id")


_LEX = ", ".join(f"('{d}', [{_strings(ws.split())}])" for d, ws in S.LEXICON.items())
_NAMES = "'x/' || ['login', 'billing', 'avatar', 'mailer', 'search', 'upload', 'plain'][1 + node_id % 7] || '/' || ['session', 'invoice', 'profile', 'smtp', 'coupon'][1 + node_id % 5] || '.ts'"


def _named():
    k = F.col("node_id")
    pick = lambda words: F.get(F.array(*(F.lit(w) for w in words.split())), (k % len(words.split())).cast("int"))
    return F.concat(F.lit("x/"), pick("login billing avatar mailer search upload plain"), F.lit("/"), pick("session invoice profile smtp coupon"), F.lit(".ts"))


@query(f", lex(domain, words) AS (VALUES {_LEX}), w AS (SELECT node_id, {_tok(_NAMES, 3, True)} AS tokens FROM paths), c AS (SELECT node_id, domain, len(list_intersect(tokens, words))::BIGINT AS votes FROM w, lex), k AS (SELECT *, rank() OVER (PARTITION BY node_id ORDER BY votes DESC) AS r FROM c WHERE votes > 0) SELECT node_id, any_value(domain) AS domain, max(votes) AS votes FROM k WHERE r = 1 GROUP BY 1 HAVING count(*) = 1", "paths")
def name_seed(t):
    return domains.single_winner(domains.word_votes(v.paths(t).select("node_id", fn.tokenize(_named()).alias("tokens")), "node_id"), "node_id")


@query(f""", lex(domain, words) AS (VALUES {_LEX}), w AS (SELECT node_id, {_tok(_NAMES, 3, True)} AS tokens FROM paths), n AS (SELECT count(*) AS n FROM paths),
df AS (SELECT token, count(*) AS files FROM (SELECT unnest(tokens) AS token FROM w) GROUP BY 1), common AS (SELECT token FROM df, n WHERE files / n > 0.6),
emergent AS (SELECT token FROM df, n WHERE files / n <= 0.5 AND files >= 3 AND length(token) >= 4 AND token NOT IN ({_KNOWN}) ORDER BY files DESC, token DESC LIMIT 12),
cl AS (SELECT coalesce(list(token), []) AS words FROM common), u AS (SELECT node_id, list_filter(tokens, lambda x: NOT list_contains(cl.words, x)) AS tokens FROM w, cl),
k AS (SELECT *, rank() OVER (PARTITION BY node_id ORDER BY votes DESC) AS r FROM (SELECT node_id, domain, len(list_intersect(tokens, words)) AS votes FROM u, lex) WHERE votes > 0),
nam AS (SELECT node_id, any_value(domain) AS w FROM k WHERE r = 1 GROUP BY 1 HAVING count(*) = 1), open AS (SELECT node_id, max(token) AS token FROM (SELECT node_id, unnest(tokens) AS token FROM u) WHERE token IN (SELECT token FROM emergent) GROUP BY 1 HAVING count(DISTINCT token) = 1),
j AS (SELECT p.node_id, CASE p.node_id % 4 WHEN 0 THEN 'PAYMENTS' WHEN 1 THEN 'AUTHENTICATION' END AS d, w, token FROM paths p LEFT JOIN nam ON p.node_id = nam.node_id LEFT JOIN open ON p.node_id = open.node_id)
SELECT node_id, coalesce(d, w, upper(token[1]) || lower(token[2:])) AS domain, CASE WHEN d = w THEN 0.95 WHEN d IS NOT NULL THEN 0.9 WHEN w IS NOT NULL THEN 0.75 ELSE 0.65 END::DOUBLE AS score,
'seed:' || CASE WHEN d = w THEN 'dependency+name' WHEN d IS NOT NULL THEN 'dependency' WHEN w IS NOT NULL THEN 'name' ELSE 'name-emergent' END AS source FROM j WHERE coalesce(d, w, token) IS NOT NULL""", "paths")
def seed_priority(t):
    n = v.paths(t).select("node_id", _named().alias("canonical_path"), F.when(F.col("node_id") % 4 == 0, F.array(F.lit("stripe"))).when(F.col("node_id") % 4 == 1, F.array(F.lit("bcrypt"), F.lit("lodash"))).alias("external_dependencies"))
    return domains.seeds(n)


@query(f", w AS (SELECT 'N' || (node_id % 25) AS cluster_id, {_tok('canonical_path', 4, True)} AS tokens FROM paths), z AS (SELECT cluster_id, count(*)::BIGINT AS members FROM w GROUP BY 1), c AS (SELECT cluster_id, token, count(*)::BIGINT AS files FROM (SELECT cluster_id, unnest(tokens) AS token FROM w) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY files DESC, token) AS r FROM c) SELECT cluster_id, upper(token[1]) || lower(token[2:]) AS domain, files, members, floor(least(0.8, files / members) * 100 + 0.5) / 100 AS confidence FROM k JOIN z USING (cluster_id) WHERE r = 1 AND members >= 2 AND files / members >= 0.4", "paths")
def emergent_name(t):
    return domains.emergent_names(v.paths(t).select(F.concat(F.lit("N"), F.col("node_id") % 25).alias("cluster_id"), fn.tokenize(F.col("canonical_path"), 4).alias("tokens")))


_RAW = "'doc ' || 'lib ' || array_to_string(regexp_extract_all(t, '//([^\\n]+)', 1), ' ')"
_BARE = f"array_to_string(list_transform(regexp_extract_all({_RAW}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda x: CASE WHEN x IN ({_strings(S.CODE_WORDS)}) THEN ' ' ELSE x END), '')"


@query(f"SELECT doc_id, left(trim(regexp_replace(regexp_replace({_BARE}, '[{{}}()\\[\\];,=><+\\-*/%&|^~!?:@#`\\\\]', ' ', 'g'), '\\s+', ' ', 'g')), 300) AS text_summary FROM (SELECT doc_id, replace(text, '. ', ' // ') AS t FROM documents)")
def text_summary(t):
    source = F.regexp_replace("text", "\\. ", " // ")
    return t.documents.select("doc_id", F.substring(fn.preprocess(source, F.lit("lib/doc.ts")), 1, 300).alias("text_summary"))


@query("""WITH j AS (SELECT event_id, 'Here is it: [' || replace(props, chr(10), ' ') || '] as asked' AS x FROM events WHERE props IS NOT NULL)
SELECT event_id, CAST(json_extract_string(regexp_extract(x, '\\[.*\\]'), '$[0].k') AS BIGINT) AS k FROM j""")
def llm_json_parse(t):
    x = F.concat(F.lit("Here is it: ["), "props", F.lit("] as asked"))
    return t.events.where("props is not null").select("event_id", fn.json_array(x, "struct<k:bigint>")[0]["k"].alias("k"))


@query("SELECT event_id, '[' || event_id || ',' || user_id || ']' AS doc, user_id AS second FROM events")
def json_roundtrip(t):
    doc = F.to_json(F.array("event_id", "user_id"))
    return t.events.select("event_id", doc.alias("doc"), F.from_json(doc, "array<bigint>")[1].alias("second"))


_CAT = "CASE node_id % 12 WHEN 0 THEN 'x.config.js' WHEN 1 THEN 'a/tests/b.ts' WHEN 2 THEN 'a/routes.ts' WHEN 3 THEN 'w/app/api/x.js' WHEN 4 THEN 'w/page.tsx' WHEN 5 THEN 'w/components/C.tsx' WHEN 6 THEN 'w/schema.js' WHEN 7 THEN 'w/types.ts' WHEN 8 THEN 'w/hooks/a.js' WHEN 9 THEN 'w/helper.js' WHEN 10 THEN 'w/middleware.js' ELSE 'w/z.css' END"
_CATS = ["x.config.js", "a/tests/b.ts", "a/routes.ts", "w/app/api/x.js", "w/page.tsx", "w/components/C.tsx", "w/schema.js", "w/types.ts", "w/hooks/a.js", "w/helper.js", "w/middleware.js", "w/z.css"]
_LABELS = ["config", "test", "route-handler", "api-route", "next-page/layout", "ui-component", "schema", "type-only", "hook", "util/lib", "middleware", "style"]


@query("SELECT [" + _strings(_LABELS) + "][1 + node_id % 12] AS category, count(*)::BIGINT AS n FROM paths GROUP BY 1", "paths")
def file_category(t):
    p = F.get(F.array(*(F.lit(x) for x in _CATS)), (F.col("node_id") % 12).cast("int"))
    return v.paths(t).groupBy(fn.file_category(p).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey % 6 IN (0, 1, 2, 3) AS is_admin, count(*)::BIGINT AS n FROM part GROUP BY 1")
def admin_partition(t):
    p = F.get(F.array(*(F.lit(x) for x in ("a/scripts/x.ts", "db/x.ts", "jest.config.js", "tools/reset-all.js", "a/dbx/y.ts", "src/config.ts"))), (F.col("p_partkey") % 6).cast("int"))
    return t.part.groupBy(fn.is_admin(p).alias("is_admin")).agg(F.count("*").alias("n"))


@query("SELECT CASE page_id % 3 WHEN 2 THEN 'a/../' ELSE 'a/' END || page_id || '.html' AS canonical_path, strlen(html) + (page_id % 4 = 0)::INTEGER AS bytes, strlen(html) > 2000 AND page_id % 4 <> 0 AS truncated, page_id % 4 = 0 AS is_binary, CASE WHEN page_id % 4 = 0 THEN 0 ELSE least(2000, strlen(html)) END AS head_bytes FROM pages WHERE page_id % 5 < 3".replace("strlen(html) + (page_id % 4 = 0)::INTEGER", "(strlen(html) + CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END)::BIGINT").replace("ELSE least(2000, strlen(html)) END", "ELSE least(2000, strlen(html)) END::INTEGER"))
def preview_truncate(t):
    """Previews of pages; a fifth of the paths is absolute and a fifth escapes, every fourth file holds a zero byte."""
    k = F.col("page_id")
    path = F.when(k % 5 == 3, F.concat(F.lit("/etc/"), k)).when(k % 5 == 4, F.concat(F.lit("a/../../"), k)).otherwise(F.concat(F.when(k % 3 == 2, "a/../").otherwise("a/"), k, F.lit(".html")))
    content = F.concat(F.when(k % 4 == 0, F.lit(b"\x00")).otherwise(F.lit(b"")), F.encode("html", "UTF-8"))
    found = code.preview(t.pages.select(path.alias("canonical_path"), content.alias("content")), 2000, 1000)
    return found.select("canonical_path", "bytes", "truncated", "is_binary", F.octet_length("head").alias("head_bytes"))


@query("SELECT node_id, array_to_string(list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(translate(regexp_replace(p_name, ' ', 'Service-', 'g'), '-_', '..'), '[A-Z][a-z]+|[a-z]+'), lambda w: lower(w))), lambda w: length(w) >= 3 AND w NOT IN (" + _strings(" ".join(S.TIERS.values()).split()) + "))), ',') AS tokens FROM paths", "paths")
def domain_tokens(t):
    path = F.concat(F.lit("lib/"), F.regexp_replace("p_name", " ", "Service-"), F.lit(".ts"))
    return v.paths(t).select("node_id", F.array_join(F.array_sort(fn.domain_tokens(path)), ",").alias("tokens"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/api/' || page_id % 9 % 2 WHEN 1 THEN '/api/x' || page_id WHEN 2 THEN '/s' || page_id || '/*' END AS url FROM pages".replace("'/api/' || page_id % 9 % 2", "'/api/*'"))
def route_url(t):
    k = F.col("page_id")
    path = F.when(k % 4 == 0, F.concat(F.lit("web/pages/api/"), k, F.lit("/index.ts"))).when(k % 4 == 1, F.concat(F.lit("pages/api/X"), k, F.lit(".js"))).when(k % 4 == 2, F.concat(F.lit("web/app/(g)/@m/S"), k, F.lit("/[id]/route.ts"))).otherwise("src/route.css")
    return t.pages.select("page_id", fn.route_url(path).alias("url"))


_DIRS2 = "SELECT DISTINCT array_to_string(string_split(canonical_path, '/')[2:4], '/') AS bucket FROM paths"


@query(f", b AS ({_DIRS2}), p AS (SELECT bucket, unnest(range(1, 1 + len(s))) AS i, unnest(s) AS part FROM (SELECT bucket, string_split(bucket, '/') AS s FROM b)), n AS (SELECT x.bucket, y.bucket AS other, count(*) AS n FROM p x JOIN p y ON x.i = y.i AND x.part = y.part AND x.bucket <> y.bucket GROUP BY 1, 2) SELECT bucket, arg_min(other, (-n, other)) AS target FROM n GROUP BY 1 UNION ALL SELECT bucket, (SELECT min(bucket) FROM b z WHERE z.bucket <> b.bucket) FROM b WHERE bucket NOT IN (SELECT bucket FROM n)", "paths")
def closest_directory(t):
    from lattica.operators.cluster import closest_directory as run

    b = v.paths(t).select(F.array_join(F.slice(F.split("canonical_path", "/"), 2, 3), "/").alias("bucket")).distinct()
    return run(b, b)


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'receiving' WHEN 'view' THEN 'resolving' WHEN 'purchase' THEN 'checkout' ELSE 'working' END AS stage FROM events")
def clone_stage(t):
    e = F.col("event_type")
    title = F.when(e == "click", "Receiving objects").when(e == "view", "remote: Resolving deltas").when(e == "purchase", "Checking out files").otherwise("Updating")
    return t.events.select("event_id", fn.clone_stage(title).alias("stage"))


@query("SELECT 'lib/' || p_partkey || '.ts' AS canonical_path, CASE p_partkey % 3 WHEN 0 THEN '/api/r' || p_partkey % 5 ELSE '/r' || p_partkey % 5 END AS url, 2 AS line, 'router' AS origin FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def server_routes(t):
    """Routes of files that use a server package, or that another file mounts under /api."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("// file\nrouter.get('/r"), k % 5, F.lit("', auth); other.get('/no');"))
    files = t.part.select(F.concat(F.lit("lib/"), k, F.lit(".ts")).alias("canonical_path"), text.alias("source"), F.when(k % 2 == 0, F.array(F.lit("Express"))).alias("external_dependencies"))
    main = t.part.where(k % 3 == 0).select(F.concat(F.lit("main/"), k, F.lit(".ts")).alias("canonical_path"), F.concat(F.lit("app.use('/api', r"), k, F.lit(");")).alias("source"), F.lit(None).cast("array<string>").alias("external_dependencies"))
    every = files.unionByName(main)
    x = written(code.extracted(every), "extracted").join(every.select("canonical_path", "external_dependencies"), "canonical_path")
    bindings = t.part.where(k % 3 == 0).select(F.concat(F.lit("main/"), k, F.lit(".ts")).alias("canonical_path"), F.concat(F.lit("r"), k).alias("name"), F.concat(F.lit("lib/"), k, F.lit(".ts")).alias("target"))
    return infer.server_routes(x, bindings).select("canonical_path", "url", "line", "origin")


@query("SELECT 'lib/' || p_partkey || '.ts' AS canonical_path, '/a/*/b' || p_partkey % 4 AS url, 1 AS line FROM part WHERE p_partkey % 4 <> 3")
def client_calls(t):
    k = F.col("p_partkey")
    call = F.when(k % 4 == 0, "fetch").when(k % 4 == 1, "axios.post").when(k % 4 == 2, "svc.request").otherwise("console.log")
    text = F.concat(call, F.lit("(`https://h.example/A/${id}/b"), k % 4, F.lit("?x=1`, opts);"))
    files = t.part.select(F.concat(F.lit("lib/"), k, F.lit(".ts")).alias("canonical_path"), text.alias("source"))
    return infer.client_calls(code.extracted(files).withColumn("external_dependencies", F.lit(None).cast("array<string>"))).select("canonical_path", "url", "line")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS n, CASE WHEN event_id % 3 = 0 THEN user_id END AS second FROM events")
def opaque_json(t):
    k = F.col("event_id")
    stored = F.when(k % 3 == 0, F.to_json(F.array("event_id", "user_id"))).when(k % 3 == 1, "no json")
    found = fn.json_list(stored, "bigint")
    return t.events.select("event_id", F.size(found).alias("n"), F.get(found, F.lit(1)).alias("second"))


_PATH_WORDS = f", w AS (SELECT node_id, list_distinct(list_filter(regexp_extract_all(p_name || ' ' || CASE WHEN node_id % 3 < 2 THEN 'shared data' ELSE 'billing' END, '[a-z]+'), lambda x: length(x) >= 3)) AS tokens FROM paths), t AS (SELECT node_id, unnest(tokens) AS token FROM w), l AS (SELECT token FROM t GROUP BY 1 HAVING count(*) / (SELECT count(*) FROM w) >= {S.LAYER_WORD_SHARE} UNION SELECT unnest([{_strings(sorted(set(S.LAYER_WORDS)))}]))"


def _path_words(t):
    words = F.regexp_extract_all(F.concat("p_name", F.lit(" "), F.when(F.col("node_id") % 3 < 2, "shared data").otherwise("billing")), F.lit("[a-z]+"), F.lit(0))
    return v.paths(t).select("node_id", F.array_distinct(F.filter(words, lambda x: F.length(x) >= 3)).alias("tokens"))


@query(_PATH_WORDS + " SELECT token FROM l", "paths")
def layer_word_set(t):
    """Words that name layers: frequent ones and those by custom."""
    return domains.layer_word_set(_path_words(t))


@query(_PATH_WORDS + " SELECT w.node_id, coalesce(string_agg(t.token, ',' ORDER BY t.token), '') AS tokens FROM w LEFT JOIN t ON t.node_id = w.node_id AND t.token NOT IN (SELECT token FROM l) GROUP BY 1", "paths")
def words_without_layers(t):
    """Each part's words without those that name layers."""
    return domains.without_layer_words(_path_words(t)).withColumn("tokens", F.array_join("tokens", ","))
