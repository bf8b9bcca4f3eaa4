"""URL filters over redirect equivalence.

Addresses are nodes; edges say that one address stands for another: its normal form (scheme, ``www.`` or ``m.``,
fragment, tracking parameters, ``.html``, closing slash), the target of ``<link rel="canonical">``, and the target of
``<meta http-equiv="refresh">``. Rules decide addresses; a decision to block spreads to all addresses of a
connected component. Allow takes precedence: an address that a rule allows stays, and a component that holds such an
address spreads no block.

A null address has an empty host and path, fits no rule, and is allowed. Repeated rows get equal verdicts. All canonical and
refresh tags of a page count. Targets are unescaped (the entities that addresses hold) and resolved against the page's address:
``//host/path``, ``/path``, ``path``, ``../path``, ``?query``. Other schemes (``mailto:``) are no addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.llm.components import components
from brickwork.session import materialize

#: Verdict, host and path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of ``verdict`` and ``rule``; null if none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def normal_form(url: Column) -> Column:
    """One spelling for the addresses that servers commonly redirect to each other; null without ``://``."""
    host = F.regexp_replace(host_of(url), r"^(?:www\.|m\.)", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(?:/index)?\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(F.concat(F.lit("&"), query), r"&(?:utm_[a-z]+|ref)=[^&]*", ""), r"^&", "")
    return F.when(F.locate("://", url) > 0, F.concat(F.lit("http://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _unescaped(value: Column) -> Column:
    """Entities as characters; the ampersand last, so that none is unescaped twice."""
    for pattern, char in ((r"(?i)&(?:quot|#0*34|#x0*22);", '"'), (r"(?i)&(?:apos|#0*39|#x0*27);", "'"), (r"(?i)&(?:sol|#0*47|#x0*2f);", "/"), (r"(?i)&(?:colon|#0*58|#x0*3a);", ":"), (r"(?i)&(?:equals|#0*61|#x0*3d);", "="), (r"(?i)&(?:quest|#0*63|#x0*3f);", "?"), (r"(?i)&(?:amp|#0*38|#x0*26);", "&")):
        value = F.regexp_replace(value, pattern, char)
    return value


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, its ``.`` and ``..`` segments carried out."""
    parts = F.slice(F.split(path, "/"), 2, 1_000_000_000)
    last = F.element_at(parts, -1)

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(closed, "/"))


def _resolved(base: Column, target: Column) -> Column:
    """The address that a target on the page ``base`` means; null if none."""
    scheme, host = F.regexp_extract(base, r"^([\s\S]*?:)//", 1), F.regexp_extract(base, r"^([\s\S]*?://[^/?#]*)", 1)
    path, rest = F.regexp_extract(target, r"^([^?#]*)", 1), F.regexp_extract(target, r"^[^?#]*([\s\S]*)", 1)
    folder = F.regexp_extract(path_of(base), r"^([\s\S]*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    within = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    query = F.regexp_extract(base, r"^([^#]*)", 1)
    return (
        F.when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), target)
        .when((target == "") | target.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") | (host == ""), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("#"), F.concat(query, target))
        .when(target.startswith("?"), F.concat(host, path_of(base), target))
        .otherwise(F.concat(host, _without_dots(within), rest))
    )


def _target(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"(?is){name}=[\"']?([^\"'\s>]+)", 1)


def edges(pages: DataFrame, url: str = "url", html: str | None = "html") -> DataFrame:
    """Links ``a``, ``b`` between addresses that stand for each other."""
    address = F.col(url)
    out = pages.select(address.alias("a"), normal_form(address).alias("b"))
    if html and html in pages.columns:
        tags = lambda pattern: F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(0))
        canonical = F.transform(tags(r"(?is)<link\s[^>]*rel=[\"']?canonical[\"']?[^>]*>"), lambda tag: _target(tag, "href"))
        refresh = F.transform(tags(r"(?is)<meta\s[^>]*http-equiv=[\"']?refresh[\"']?[^>]*>"), lambda tag: _target(tag, "url"))
        found = pages.where(F.lower(F.col(html)).rlike("canonical|http-equiv")).select(address.alias("a"), F.explode(F.concat(canonical, refresh)).alias("t"))
        found = found.select("a", _resolved(F.col("a"), _unescaped(F.col("t"))).alias("t"))
        found = materialize(found.where(F.col("t").isNotNull()), "targets")
        out = out.unionByName(found.select("a", F.col("t").alias("b"))).unionByName(found.select(F.col("t").alias("a"), normal_form(F.col("t")).alias("b")))
    return out.where(F.col("a").isNotNull() & F.col("b").isNotNull())


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str | None = "html", rules=RULES, links: DataFrame | None = None) -> DataFrame:
    """Key, host, path, rule and verdict of every page; ``links`` adds redirects known from elsewhere (``a``, ``b``)."""
    every = edges(pages, url, html)
    if links is not None:
        every = every.unionByName(links.select("a", "b"))
    member = materialize(components(every), "aliases")
    decided = matched_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    by_group = member.select("component", decided["verdict"].alias("v")).where(F.col("v").isNotNull())
    by_group = by_group.groupBy("component").agg(F.max(F.col("v") == "block").alias("block"), F.max(F.col("v") == "allow").alias("allow"))
    spread = by_group.where(F.col("block") & ~F.col("allow")).select("component")
    blocked = member.join(spread, "component", "left_semi").select(F.col("node").alias("_node"), F.lit(True).alias("_blocked"))
    own = matched_rule(F.col("host"), F.col("path"), rules)
    out = pages.select(key, url).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumn("_own", own)
    out = out.join(blocked, F.col(url) == F.col("_node"), "left")
    verdict = F.coalesce("_own.verdict", F.when(F.col("_blocked"), "block"), F.lit("allow"))
    return out.select(key, "host", "path", F.col("_own.rule").alias("rule"), verdict.alias("verdict"))
