"""URL filter: policy rules, and a list of canonical URLs behind a blocked Bloom filter.

A rule (verdict, host, path) fits its host and all subdomains if the path begins with the rule's;
the longest rule wins, block before allow among equals. Urls that no rule decides are tested
against the list: the Bloom filter passes possible hits, an exact hash join removes the false
ones; what is listed is blocked, the rest allowed. Only possible hits are shuffled.

A canonical url is the lower-cased host without `www.` and the path without slashes at its end;
scheme, query and fragment don't count.

Defined cases: a null url or one without `://` has an empty host and path, fits no rule, is not
listed and so allowed; nulls and repetitions in the list have no effect; an empty list or table
is fine; repeated rows are judged each; a null page_id is carried along; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm import bloom

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def canonical(host_: Column, path_: Column) -> Column:
    """Null for an empty host."""
    plain = F.concat(F.regexp_replace(host_, "^www\\.", ""), F.regexp_replace(path_, "/+$", ""))
    return F.when(host_ != "", plain)


def _decided(rules: tuple, host_: Column, path_: Column) -> tuple[Column, Column]:
    """The winning rule's text and verdict, or null. The rules are a short list, checked in order of length."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r))
    name = verdict = None
    for v, h, p in ordered:
        fits = ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (name, verdict) if ordered else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def url_filter(pages: DataFrame, listed: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, possible and listed of every row of pages (page_id, url).

    listed has a column url; possible tells what the Bloom filter passed (null: a rule decided)."""
    keys = listed.select(canonical(host(F.col("url")), path(F.col("url"))).alias("key")).where("key is not null").distinct()
    filter_ = bloom.build(keys, "key")
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    name, verdict = _decided(rules, F.col("host"), F.col("path"))
    judged = parsed.select("*", name.alias("rule"), verdict.alias("by_rule"), canonical(F.col("host"), F.col("path")).alias("key"))
    tested = bloom.tested(judged, "key", filter_, "maybe").withColumn("possible", F.when(F.col("rule").isNull(), F.col("maybe") & F.col("key").isNotNull()))
    sure = tested.where("rule is not null or not possible").withColumn("listed", F.lit(False))
    hits = tested.where("rule is null and possible").join(keys.withColumn("listed", F.lit(True)), "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    both = sure.unionByName(hits)
    return both.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "possible", "listed")
