"""Links that imports don't show: naming, routing, HTTP and event contracts, shared state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica import schemas as S
from lattica.functions import scalar as fn
from lattica.operators.joins import paired
from lattica.session import written

PAIR = ["source_id", "target_id"]
MEMBERS = 128  # files in a block; Spark holds the pairs of two blocks at once
RUN = 1 << 24  # naming pairs that one task makes of a word


def synthetic(pairs: DataFrame, kind: str, weight: float) -> DataFrame:
    """Pairs as edges of a type."""
    return pairs.select("source_id", "target_id", F.lit(weight).alias("weight"), F.lit(kind).alias("edge_type"), F.lit("").alias("binding"), (F.col("called_names") if "called_names" in pairs.columns else F.array().cast("array<string>")).alias("called_names"), F.lit(False).alias("is_dead_import"), F.lit(True).alias("is_synthetic"))


def naming_groups(files: DataFrame) -> DataFrame:
    """token, source_tier, target_tier, sources, targets, links: files of a lower tier and of a higher one that share a word.

    The links of a word are kept as two groups and their product, never as pairs, so the rows are as
    many as words, not as files squared. files: node_id, tier, tokens (distinct)."""
    held = files.where("tier is not null").select("tier", F.explode("tokens").alias("token")).groupBy("token", "tier").agg(F.count("*").alias("files"))
    by_word = held.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("tier", "files"))).alias("tiers"))  # tiers are a handful
    pairs = F.flatten(F.transform("tiers", lambda a: F.transform(F.filter("tiers", lambda b: b["tier"] > a["tier"]), lambda b: F.struct(a.alias("s"), b.alias("t")))))
    rows = by_word.select("token", F.explode(pairs).alias("p"))
    s, t = F.col("p.s"), F.col("p.t")
    return rows.select("token", s["tier"].alias("source_tier"), t["tier"].alias("target_tier"), s["files"].alias("sources"), t["files"].alias("targets"), (s["files"] * t["files"]).alias("links"))


def naming_edges(files: DataFrame, existing: DataFrame | None = None, show: Callable[[Column], Column] = lambda names: names) -> DataFrame:
    """source_id, target_id, called_names: files of a lower tier to files of a higher one that share a word.

    files: node_id, tier, tokens. The pairs of `naming_groups` written out, each made once and never shuffled.
    Files with the same words are alike, so what they share (as show makes it of a sorted array) is found once for
    two blocks of MEMBERS files at most; they meet at each word they share, and count at the first one only."""
    spread = files.where("tier is not null").select("node_id", "tier", F.explode("tokens").alias("token")).where("token is not null")
    ends = spread.groupBy("node_id", "token").agg(F.min("tier").alias("low"), F.max("tier").alias("high"))
    alike = ends.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("token", "low", "high"))).alias("words"))
    blocks = written(_blocks(alike), "blocks")
    side = lambda ids, words: blocks.select(F.col("ids").alias(ids), F.col("words").alias(words), F.explode("words.token").alias("token"))
    met = paired(side("sources", "sw"), side("targets", "tw"), "token", RUN, (F.size("sources"), F.size("targets")))
    shared = F.transform(F.filter("sw", lambda a: F.exists("tw", lambda b: (a["token"] == b["token"]) & (a["low"] < b["high"]))), lambda a: a["token"])
    links = met.withColumn("names", shared).where(F.get("names", F.lit(0)) == F.col("token")).select("sources", "targets", show(F.col("names")).alias("called_names"))
    found = links.select(F.explode("sources").alias("source_id"), "targets", "called_names").select("source_id", F.explode("targets").alias("target_id"), "called_names")
    return found if existing is None else found.join(existing.select(PAIR), PAIR, "left_anti")


def _blocks(alike: DataFrame) -> DataFrame:
    """words, ids: files (node_id) with equal words, MEMBERS of them to a block as dealt by hash."""
    sizes = alike.groupBy("words").agg(F.ceil(F.count("*") / MEMBERS).alias("dealt"))
    block = F.pmod(F.xxhash64("node_id"), F.col("dealt"))
    ids = F.when(F.col("none"), F.array(F.first("node_id"))).otherwise(F.collect_list("node_id"))  # a list leaves null out
    return alike.join(sizes, "words").groupBy("words", block.alias("block"), F.col("node_id").isNull().alias("none")).agg(ids.alias("ids")).select("words", "ids")


def sibling_edges(files: DataFrame) -> DataFrame:
    """Both directions between the convention files of a directory; files: node_id, dir."""
    f = files.select("node_id", "dir")
    return paired(f.toDF("source_id", "dir"), f.toDF("target_id", "dir"), "dir").where("source_id <> target_id").select(PAIR)


def ancestors(dir_):
    """All directories above a path, nearest first, with their depth; `.` is above everything."""
    parts = F.split(dir_, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/"))
    return F.when(dir_ == ".", F.array().cast("array<string>")).otherwise(F.concat(F.filter(above, lambda x: x != ""), F.array(F.lit("."))))


def layout_edges(files: DataFrame, layouts: DataFrame) -> DataFrame:
    """From the layout of the nearest strict ancestor directory to each file.

    files: node_id, dir; layouts: layout_id, dir."""
    up = files.select("node_id", F.posexplode(ancestors(F.col("dir"))).alias("depth", "dir"))
    near = up.join(layouts, "dir").groupBy("node_id").agg(F.min_by("layout_id", F.struct("depth", "layout_id")).alias("layout_id"))
    return near.where("layout_id <> node_id").select(F.col("layout_id").alias("source_id"), F.col("node_id").alias("target_id"))


def url_pairs(clients: DataFrame, servers: DataFrame) -> DataFrame:
    """client, server, url of client addresses that a server's route matches, `*` being any segment.

    Both have id and url. Joined on the number of segments and on the place and text of the route's
    last segment that isn't `*`; a client has a key for each of its segments, so a pair meets once.
    Routes of nothing but `*` are joined on the number alone. The rest is a residual."""
    known = lambda d, n: d.where("url is not null").select(F.col("id").alias(n), F.col("url").alias(f"{n}_url"), fn.segments(F.col("url")).alias("s")).withColumn("arity", F.size("s"))
    places = F.transform("s", lambda x, i: F.struct(i.alias("at"), x.alias("part")))
    free = F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("part")))
    c = known(clients, "client").select("client", "client_url", "arity", F.explode(F.concat(free, places)).alias("k")).select("client", "client_url", "arity", "k.*")
    plain = F.filter(places, lambda x: x["part"] != "*")
    last = F.try_element_at(plain, F.lit(-1))
    keys = F.when(F.size(plain) > 0, F.array(last, F.struct(last["at"].alias("at"), F.lit("*").alias("part")))).otherwise(free)
    s = known(servers, "server").select("server", "server_url", "arity", F.explode(keys).alias("k")).select("server", "server_url", "arity", "k.*")
    return c.join(s, ["arity", "at", "part"]).where(fn.urls_match(F.col("client_url"), F.col("server_url"))).select("client", "server", F.col("server_url").alias("url"))


def event_groups(emitters: DataFrame, listeners: DataFrame) -> DataFrame:
    """event, emitters, listeners, links: how many files emit and await each event, and the product; both sides have id and event."""
    count = lambda d, n: d.select("id", "event").distinct().groupBy("event").agg(F.count("*").alias(n))
    return count(emitters, "emitters").join(count(listeners, "listeners"), "event").withColumn("links", F.col("emitters") * F.col("listeners"))


def event_pairs(emitters: DataFrame, listeners: DataFrame) -> DataFrame:
    """emitter, listener, event; both sides have id and event. An event of many pairs is split over tasks."""
    return paired(emitters.select(F.col("id").alias("emitter"), "event").distinct(), listeners.select(F.col("id").alias("listener"), "event").distinct(), "event")


def admitted(links: DataFrame, existing: DataFrame) -> DataFrame:
    """One link for each (source_id, target_id, edge_type) without loops or known pairs.

    links: source_id, target_id, edge_type, label, line; labels unite, the first line stands."""
    new = links.where("source_id <> target_id").join(existing.select(PAIR), PAIR, "left_anti")
    return new.groupBy("source_id", "target_id", "edge_type").agg(F.array_sort(F.collect_set("label")).alias("called_names"), F.min("line").alias("source_line"))


def state_edges(imports: DataFrame, existing: DataFrame, most: int = S.MAX_STATE_PAIRS) -> DataFrame:
    """source_id (provider), target_id (consumer), label: files that meet in a shared-state module.

    imports: source_id, target_id (the module), label, provides, consumes. A module whose providers
    times consumers exceed `most` is left out before anything is paired."""
    sides = imports.groupBy("target_id").agg(F.first("label").alias("label"), F.sum(F.col("provides").cast("long")).alias("p"), F.sum(F.col("consumes").cast("long")).alias("c"))
    fit = sides.where((F.col("p") > 0) & (F.col("c") > 0) & (F.col("p") * F.col("c") <= most)).select("target_id", "label")
    rows = imports.drop("label").join(fit, "target_id")
    p = rows.where("provides").select("target_id", "label", F.col("source_id").alias("provider")).distinct()
    c = rows.where("consumes").select("target_id", F.col("source_id").alias("consumer")).distinct()
    pairs = p.join(c, "target_id").where("provider <> consumer").groupBy(F.col("provider").alias("source_id"), F.col("consumer").alias("target_id")).agg(F.min("label").alias("label"))
    return pairs.join(existing.select(PAIR), PAIR, "left_anti")


def first_string(args):
    """The first non-empty string among a call's arguments."""
    return F.try_element_at(F.filter(args, lambda a: (a["kind"] == "string") & (a["value"] != "")), F.lit(1))["value"]


def _exploded(files: DataFrame) -> DataFrame:
    """A row for each call: canonical_path, server, callee, obj, method, line, args, seq."""
    server = F.arrays_overlap(F.transform(F.coalesce("external_dependencies", F.array().cast("array<string>")), F.lower), F.array(*(F.lit(x) for x in S.SERVER_PACKAGES)))
    calls = files.select("canonical_path", server.alias("server"), F.posexplode("calls").alias("seq", "call"))
    callee = F.col("call.callee")
    return calls.select("canonical_path", "server", "seq", callee.alias("callee"), F.when(callee.contains("."), F.regexp_extract(callee, r"^(.*)\.[^.]*$", 1)).alias("obj"), F.substring_index(callee, ".", -1).alias("method"), F.col("call.line").alias("line"), F.col("call.args").alias("args"))


def mount_prefixes(files: DataFrame, bindings: DataFrame) -> DataFrame:
    """target, prefix: where routers are mounted; bindings: canonical_path, name, target."""
    uses = _exploded(files).where((F.col("method") == "use") & first_string(F.col("args")).startswith("/"))
    named = uses.select("canonical_path", "seq", first_string(F.col("args")).alias("prefix"), F.explode(F.filter("args", lambda a: a["kind"] == "identifier")).alias("arg"))
    named = named.withColumn("name", F.substring_index("arg.value", ".", 1))
    return named.join(bindings, ["canonical_path", "name"]).groupBy("target").agg(F.min_by("prefix", F.struct("canonical_path", "seq")).alias("prefix"))


def server_routes(files: DataFrame, bindings: DataFrame) -> DataFrame:
    """url, canonical_path, line, origin of every route that a file serves."""
    by_path = files.select(fn.route_url(F.col("canonical_path")).alias("url"), "canonical_path", F.lit(1).alias("line"), F.lit("convention").alias("origin")).where("url is not null")
    mounts = mount_prefixes(files, bindings).withColumnRenamed("target", "canonical_path")
    calls = _exploded(files).join(mounts, "canonical_path", "left").where(F.col("server") | F.col("prefix").isNotNull())
    calls = calls.where(F.lower("method").isin(*S.HTTP_VERBS) & F.col("obj").isin(*S.ROUTER_OBJECTS)).withColumn("path", first_string(F.col("args"))).where(F.col("path").startswith("/"))
    return by_path.unionByName(calls.select(fn.join_url(F.coalesce("prefix", F.lit("")), F.col("path")).alias("url"), "canonical_path", "line", F.lit("router").alias("origin")))


def client_calls(files: DataFrame) -> DataFrame:
    """url, canonical_path, line of every outbound HTTP call."""
    c = _exploded(files)
    verb = F.lower("method").isin(*S.HTTP_VERBS) & F.col("obj").isin(*S.CLIENT_OBJECTS)
    own = F.col("server") & F.col("obj").isin(*S.ROUTER_OBJECTS)
    other = F.col("method").isin("fetch", "request") & F.col("obj").isNotNull() & ~F.col("obj").isin(*S.ROUTER_OBJECTS)
    is_client = F.col("callee").isin(*S.CLIENT_FUNCTIONS) | F.when(verb, ~own).otherwise(other)
    urls = F.filter(F.transform(F.filter("args", lambda a: a["kind"] == "string"), lambda a: fn.normalize_url(a["value"])), lambda u: u.isNotNull() & (u != "/"))
    return c.where(is_client).select(F.try_element_at(urls, F.lit(1)).alias("url"), "canonical_path", "line").where("url is not null")


def event_calls(files: DataFrame) -> DataFrame:
    """event, canonical_path, line, emits of calls that emit or await named events."""
    c = _exploded(files).where(F.col("method").isin(*S.EMITS, *S.LISTENS))
    return c.select(fn.event_name(first_string(F.col("args"))).alias("event"), "canonical_path", "line", F.col("method").isin(*S.EMITS).alias("emits")).where("event is not null")


def contract_edges(files: DataFrame, bindings: DataFrame, existing: DataFrame) -> DataFrame:
    """CALLS_API and EMITS_EVENT edges by path (source_id and target_id are paths)."""
    cl, sv, ev = client_calls(files), server_routes(files, bindings), event_calls(files)
    api = url_pairs(cl.select(F.col("canonical_path").alias("id"), "url").distinct(), sv.select(F.col("canonical_path").alias("id"), "url").distinct())
    api = api.select(F.col("client").alias("source_id"), F.col("server").alias("target_id"), F.lit("CALLS_API").alias("edge_type"), F.col("url").alias("label"), F.lit(None).cast("int").alias("line"))
    pairs = event_pairs(ev.where("emits").select(F.col("canonical_path").alias("id"), "event"), ev.where("not emits").select(F.col("canonical_path").alias("id"), "event"))
    events = pairs.select(F.col("emitter").alias("source_id"), F.col("listener").alias("target_id"), F.lit("EMITS_EVENT").alias("edge_type"), F.col("event").alias("label"), F.lit(None).cast("int").alias("line"))
    return admitted(api.unionByName(events), existing)


def first_of_directory(files: DataFrame) -> DataFrame:
    """layout_id, dir: the first layout of each directory."""
    w = Window.partitionBy("dir").orderBy("node_id")
    return files.withColumn("n", F.row_number().over(w)).where("n = 1").select(F.col("node_id").alias("layout_id"), "dir")
