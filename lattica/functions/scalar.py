"""Column functions on paths, URLs, tokens, vectors and JSON: all built from Spark SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica import schemas as S


def _list(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def name(path: Column) -> Column:
    """Last component."""
    return F.substring_index(posix(path), "/", -1)


def stem(path: Column) -> Column:
    """Last component without its last suffix; a leading dot belongs to the stem."""
    return F.regexp_replace(name(path), r"^(.+)\.[^.]*$", "$1")


def suffix(path: Column) -> Column:
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def parent(path: Column) -> Column:
    """Directory, `.` for a file at the root."""
    p = posix(path)
    return F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit("."))


def camel_tokens(text: Column, least: int) -> Column:
    """Distinct lower-case words of a path, split at capitals, of least characters or more."""
    t = F.regexp_replace(posix(text), "([a-z0-9])([A-Z])", "$1 $2")
    t = F.regexp_replace(t, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    found = F.regexp_extract_all(t, F.lit("[a-zA-Z][a-zA-Z0-9]*"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, lambda x: F.length(x) >= least), F.lower))


def tokenize(text: Column, least: int = 3) -> Column:
    return F.array_except(camel_tokens(text, least), _list(S.STOPWORDS))


def domain_tokens(path: Column) -> Column:
    """Words of a stem for layer matching, without layer names."""
    found = F.regexp_extract_all(F.translate(stem(path), "-_", ".."), F.lit("[A-Z][a-z]+|[a-z]+"), F.lit(0))
    words = F.filter(F.transform(found, F.lower), lambda x: F.length(x) >= 3)
    return F.array_except(words, _list(" ".join(S.TIERS.values()).split()))


def _tier(word: Column) -> Column:
    out = None
    for t, words in S.TIERS.items():
        out = F.when(word.isin(words.split()), t) if out is None else out.when(word.isin(words.split()), t)
    return out


def file_layer(path: Column) -> Column:
    """Tier of the first layer word of the stem, else of the directory's name; null if none."""
    parts = F.split(F.translate(F.lower(stem(path)), "-_", ".."), "\\.")
    tiers = F.filter(F.transform(parts, _tier), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(tiers, F.lit(1)), _tier(F.lower(name(parent(path)))))


def canonical_bucket(path: Column, depth: int = 2) -> Column:
    parts = F.split(posix(path), "/")
    return F.when(F.size(parts) <= 1, stem(path)).otherwise(F.array_join(F.slice(parts, 1, depth), "/"))


def normalize_url(raw: Column) -> Column:
    """Comparable path of a url or route: no scheme, host, query or fragment, `*` for variable segments."""
    u = F.regexp_replace(raw, r"^\s+|\s+$", "")
    absolute = u.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(/.*)?$")
    rest = F.regexp_extract(u, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(/.*)?$", 1)
    double = F.regexp_extract(u, "(?s)^//[^/]*(/.*)$", 1)
    whole = F.when(absolute, F.when(rest == "", "/").otherwise(rest)).when(u.startswith("//"), F.when(double == "", "/").otherwise(double)).otherwise(u)
    path = F.regexp_replace(whole, r"(?s)[?#].*$", "")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    variable = lambda s: s.rlike(r"^(\[.*\]|:.+|\*|\{.*\})$") | s.rlike("^[0-9]+$") | s.contains("${") | s.contains("*")
    shown = F.transform(segments, lambda s: F.when(variable(s), "*").otherwise(F.lower(s)))
    return F.when(path.startswith("/"), F.concat(F.lit("/"), F.array_join(shown, "/")))


def segments(url: Column) -> Column:
    return F.filter(F.split(url, "/"), lambda s: s != "")


def urls_match(a: Column, b: Column) -> Column:
    """Segment-wise equality with `*` on either side; put an equality of segment counts in the join key."""
    x, y = segments(a), segments(b)
    return (a == b) | ((F.size(x) == F.size(y)) & F.forall(F.zip_with(x, y, lambda p, q: (p == q) | (p == "*") | (q == "*")), lambda z: z))


def join_url(prefix: Column, path: Column) -> Column:
    return F.coalesce(normalize_url(F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))), F.lit("/"))


def _below_app(path: Column) -> Column:
    """Directories between `app` and the file; null without `app`."""
    dirs = F.split(posix(path), "/")
    dirs = F.slice(dirs, F.lit(1), F.size(dirs) - 1)
    at = F.array_position(dirs, "app").cast("int")
    return F.when(at > 0, F.slice(dirs, at + 1, F.greatest(F.size(dirs) - at, F.lit(0))))


def page_url(path: Column) -> Column:
    """Address of an app-router page or route, with `:name` for variable segments; null for other files."""
    kept = F.filter(_below_app(path), lambda s: ~s.rlike(r"^\([^)]+\)$") & ~s.startswith("@"))
    shown = F.transform(kept, lambda s: F.when(s.rlike(r"^\[.*\]$"), F.concat(F.lit(":"), F.regexp_replace(s, r"^[\[\].]+|[\[\].]+$", ""))).otherwise(s))
    return F.when(F.lower(stem(path)).isin("page", "route"), F.concat(F.lit("/"), F.array_join(shown, "/")))


def route_url(path: Column) -> Column:
    """Address that a route file serves by convention; null for other files."""
    p = posix(path)
    kept = F.filter(_below_app(path), lambda s: (s != "") & ~s.rlike(r"^\([^)/]+\)$") & ~s.startswith("@"))
    by_app = F.when(F.size(kept) > 0, normalize_url(F.concat(F.lit("/"), F.array_join(kept, "/"))))
    route = F.regexp_extract(p, r"(?i)(^|/)pages/api/(.+)\.(ts|js|tsx|jsx|mjs)$", 2)
    by_pages = F.when(route != "", normalize_url(F.concat(F.lit("/api/"), F.regexp_replace(route, "/index$", ""))))
    return F.when(p.rlike(r"(?i)(^|/)route\.(ts|js|tsx|jsx|mjs)$"), by_app).otherwise(by_pages)


def same_components(a: Column, b: Column) -> Column:
    """Path components that are equal at the same place."""
    pairs = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def package(spec: Column) -> Column:
    """Package of an import path; null for relative ones."""
    parts = F.split(spec, "/")
    scoped = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, 2), "/")).otherwise(spec)
    return F.when(spec.startswith(".") | spec.startswith("/") | (spec == ""), None).when(spec.startswith("@"), scoped).otherwise(F.get(parts, F.lit(0)))


def package_domain(dep: Column) -> Column:
    """Business domain of a package: by name, by root package, by prefix; null if unknown."""
    d = F.lower(F.trim(dep))
    exact = F.create_map(*(F.lit(x) for dom, ps in S.PACKAGES.items() for p in ps.split() for x in (p, dom)))
    prefix = F.lit(None).cast("string")
    for p, dom in reversed(S.PACKAGE_PREFIXES):
        prefix = F.when(d.startswith(p), dom).otherwise(prefix)
    return F.coalesce(F.try_element_at(exact, d), F.try_element_at(exact, package(d)), prefix)


def is_admin(path: Column) -> Column:
    return path.rlike(S.ADMIN_SEGMENT) | name(path).rlike(S.ADMIN_NAME)


def is_test(path: Column) -> Column:
    return path.rlike(S.TEST_FILE)


def event_name(raw: Column) -> Column:
    """Lower-case name of a cross-file event; null for DOM events and plain words."""
    n = F.trim(raw)
    plain = ~n.rlike("[:._-]") & (n == F.lower(n)) & n.rlike("[a-z]")
    return F.when(~(F.lower(n).isin(S.DOM_EVENTS) | (F.length(n) < 3) | n.contains(" ") | plain), F.lower(n))


def is_shared_ui(path: Column) -> Column:
    out = F.lit(False)
    for hint in S.SHARED_UI:
        out = out | posix(path).contains(hint)
    return out


def edge_class(source: Column, target: Column) -> Column:
    """RENDERS for shared UI and for components of entry files, else BELONGS_TO_DOMAIN."""
    component = stem(target).rlike("^[A-Z]") & ~F.lower(stem(target)).isin(*S.ENTRY_STEMS)
    return F.when(is_shared_ui(target) | (F.lower(stem(source)).isin(*S.ENTRY_STEMS) & component), "RENDERS").otherwise("BELONGS_TO_DOMAIN")


def preprocess(source: Column, path: Column) -> Column:
    """Words of comments, stem and directories without code words and symbols; the stem if none is left."""
    comments = F.array_join(F.transform(F.regexp_extract_all(source, F.lit(r"(?ms)//.+?$|/\*.+?\*/"), F.lit(0)), lambda c: F.regexp_replace(c, r"(?s)^//|^/\*|\*/$", "")), " ")
    title = F.translate(stem(path), "-_.", "   ")
    dirs = F.when(posix(path).contains("/"), F.translate(F.translate(parent(path), "/", " "), "-_", "  ")).otherwise("")
    raw = F.concat_ws(" ", title, dirs, comments)
    raw = F.regexp_replace(raw, r"\b(" + "|".join(S.CODE_WORDS) + r")\b", " ")
    raw = F.regexp_replace(raw, r"[{}()\[\];,=><+\-*/%&|^~!?:@#`\\]", " ")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(raw, r"\s+", " ")), F.lit("")), title)


# Categories of files by patterns on their lower-case paths, the first that fits.
_CATEGORIES = (
    ("config", r"\.(config|setup|env)\.[a-z]+$"),
    ("test", r"\.(test|spec)\.[a-z]+$|/tests/|/__tests__/|/spec/"),
    ("route-handler", r"route[^/]*\.ts$"),
    ("api-route", r"/app/api/|/pages/api/"),
    ("next-page/layout", r"(page|layout|loading|error)\.tsx[^/]*$"),
    ("ui-component", r"/(components|ui)/.*\.tsx$"),
    ("schema", r"schema[^/]*$|/schemas/"),
    ("type-only", r"type[^/]*\.ts$|type[^/]*\.d\.ts$"),
    ("hook", r"/hooks/|(^|/)use-[^/]*$"),
    ("util/lib", r"(util|helper)[^/]*$|/utils/|/lib/"),
    ("constants", r"constant[^/]*$|/constants/"),
    ("middleware", r"middleware[^/]*$"),
    ("server-action", r"action[^/]*\.ts$"),
    ("style", r"\.s?css$|tailwind"),
)


def file_category(path: Column) -> Column:
    p, out = F.lower(path), None
    for label, pattern in _CATEGORIES:
        out = F.when(p.rlike(pattern), label) if out is None else out.when(p.rlike(pattern), label)
    return out.otherwise("other")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def half_up(x: Column, digits: int) -> Column:
    """Rounded half up on the binary value, the same in every engine."""
    return F.floor(x * F.lit(float(10**digits)) + 0.5) / F.lit(float(10**digits))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a vector without length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def json_array(text: Column, ddl: str) -> Column:
    """The JSON array inside free text, parsed tolerantly."""
    return F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), f"array<{ddl}>")


def json_list(text: Column, ddl: str) -> Column:
    """A stored JSON list; empty if there is none or it can't be read."""
    return F.coalesce(F.from_json(text, f"array<{ddl}>"), F.array().cast(f"array<{ddl}>"))


def trim_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def repository_url(text: Column) -> Column:
    """Clone address of a repository page, ending in .git; null if it is none."""
    t = F.trim(text)
    plain = F.when(t.endswith(".git"), t).otherwise(F.concat(F.regexp_replace(t, "/$", ""), F.lit(".git")))
    return F.when(t.rlike(r"(?i)^https?://(www\.)?github\.com/[\w.-]+/[\w.-]+(\.git)?/?$"), plain)


def clone_stage(title: Column) -> Column:
    t = F.lower(title)
    return F.when(t.contains("receiving"), "receiving").when(t.contains("resolving"), "resolving").when(t.contains("counting"), "counting").when(t.contains("compressing"), "compressing").when(t.contains("checking out"), "checkout").otherwise("working")


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100).cast("long"), F.call_function("div", done.cast("long") * 100, total.cast("long")))).otherwise(F.lit(0).cast("long"))
