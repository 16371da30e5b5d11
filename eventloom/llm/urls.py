"""URL filter by rules, with block decisions spread over redirect and canonical aliases. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii
from .components import components

#: (verdict, rule): host, then path from its slash.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Names of character references decoded in link targets; fixed values of HTML.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&#x2F;", "/"), ("&#47;", "/"), ("&apos;", "'"), ("&#38;", "&"), ("&amp;", "&")]
#: A link or meta tag, up to the next < or >. Attributes are looked for inside one tag only, so that time grows with the page.
TAGS = r"(?i)<(?:link|meta)[\x20\t\r\n\f/][^<>]*"
REFRESH_URL = r"""(?is)\burl\s*=\s*("[^"]*|'[^']*|\S+)"""


def _rest(url: Column) -> Column:
    """What follows the first ://, up to ? or #; empty without one."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    tail = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    return F.substring_index(F.substring_index(tail, "?", 1), "#", 1)


def host_of(url: Column) -> Column:
    return lower_ascii(F.substring_index(_rest(url), "/", 1))


def path_of(url: Column) -> Column:
    rest = _rest(url)
    at = F.instr(rest, "/")
    return F.when(at > 0, F.substr(rest, at)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits (equal lengths: allow first, then by text), or null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0], r[1])):
        at = rule.index("/")
        h, p = rule[:at].lower(), rule[at:]
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        hit = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def canonical_form(url: Column) -> Column:
    """The url without scheme, www., query, fragment, closing slash and .html; null if it has no host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"(\.html?|/)$", "")
    return F.when(host != "", F.concat(F.lit("//"), host, path))


def address(url: Column) -> Column:
    """The url as a node: scheme and host in lower case, no fragment, / for an empty path."""
    u = F.substring_index(url.cast("string"), "#", 1)
    at = F.instr(u, "://")
    rest = F.substr(u, at + 3)
    host = F.regexp_extract(rest, "^[^/?]*", 0)
    tail = F.substr(rest, F.length(host) + 1)
    return F.when(at > 0, F.concat(lower_ascii(F.substr(u, F.lit(1), at + 2)), lower_ascii(host), F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail)))).otherwise(u)


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or bare; empty without one."""
    return _value(F.regexp_extract(tag, rf"""(?is)[\x20\t\r\n\f/"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)""", 1))


def _value(c: Column) -> Column:
    """An attribute's value without its quotes, entities decoded."""
    c = F.regexp_replace(c, r"""^["']|["']$""", "")
    for name, to in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(to))
    return F.trim(c)


def _resolved(url: Column, target: Column) -> Column:
    """target as an address, relative ones against url; null if url has no host to resolve against."""
    scheme, host, path = F.substring_index(url, "://", 1), host_of(url), path_of(url)
    root = F.when(host != "", F.concat(scheme, F.lit("://"), host))
    bare = F.substring_index(F.substring_index(target, "#", 1), "?", 1)
    tail = F.substr(target, F.length(bare) + 1)
    whole = F.when(bare.startswith("/"), bare).when(bare == "", path).otherwise(F.concat(F.regexp_replace(F.when(path == "", "/").otherwise(path), r"[^/]*$", ""), bare))
    parts = F.split(F.regexp_replace(F.regexp_replace(whole, r"^/", ""), r"(^|/)(\.\.?)$", "$1$2/"), "/", -1)
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    at = F.when(whole == "", "").otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).otherwise(F.concat(root, at, tail))


def html_links(pages: DataFrame) -> DataFrame:
    """(url, target) of <link rel=canonical> and <meta http-equiv=refresh> in html; relative targets are resolved against url."""

    def target(tag: Column) -> Column:
        canonical = F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
        refresh = F.lower(_attribute(tag, "http-equiv")) == "refresh"
        return F.when(F.lower(F.substring(tag, 2, 4)) == "link", F.when(canonical, _attribute(tag, "href"))).when(refresh, _value(F.regexp_extract(_attribute(tag, "content"), REFRESH_URL, 1)))

    tags = F.when(F.col("html").rlike("(?i)canonical|refresh"), F.regexp_extract_all("html", F.lit(f"({TAGS})"), F.lit(1)))
    found = pages.where("url IS NOT NULL AND html IS NOT NULL").select("url", F.explode(F.array_distinct(F.transform(tags, target))).alias("t")).where("t <> ''")
    return found.select("url", _resolved(F.col("url"), F.col("t")).alias("target")).where("target <> ''")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules: list[tuple[str, str]] = RULES, default: str = "allow", same_form: bool = False) -> DataFrame:
    """(page_id, host, path, rule, verdict, component, decided_by) of pages(page_id, url, html).

    Edges: redirects(url, target), and canonical and refresh links in html. Urls that differ in the case of scheme or
    host, in the fragment or in an empty path are one. With same_form, addresses that differ in query, scheme, www.,
    closing slash or .html are joined as well. Connected urls are one resource. A url under a rule has that rule's
    verdict. Any other takes allow if a url of its resource is allowed by a rule (explicit allow comes first), else block
    if one is blocked, else default.

    Null urls and urls without :// have an empty host and path, fit no rule unless a rule has an empty host, and are
    linked only by edges that name them. Repeated rows stay. Without html only the other edges count. An empty table
    gives no rows. Long or broken pages take time in proportion to their length. Other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    if "html" not in pages.columns:
        pages = pages.withColumn("html", F.lit(None).cast("string"))
    node = lambda c: F.md5(address(F.col(c)).cast("binary"))  # noqa: E731  urls as fixed-size keys
    slim = pages.select("page_id", F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    links = html_links(pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("url").cast("string").alias("url"), F.col("target").cast("string").alias("target")))
    links = scratch.keep(links.where("url IS NOT NULL AND target IS NOT NULL"), "links")
    ends = links.select("url").unionByName(links.select(F.col("target").alias("url")))
    edges = links
    if same_form:
        ends = ends.unionByName(slim.select("url")).where("url IS NOT NULL").distinct()
        edges = edges.unionByName(ends.select("url", canonical_form(F.col("url")).alias("target")).where("target IS NOT NULL"))
    of = scratch.keep(components(edges.select(node("url").alias("a"), node("target").alias("b")), scratch), "of")
    ruled = ends.select(node("url").alias("node"), rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("v")).where("v IS NOT NULL")
    # only components that hold a ruled url pass a decision on: allow sorts before block
    spread = ruled.join(of, "node").groupBy("component").agg(F.min("v").alias("spread"))
    of = scratch.keep(of.join(spread, "component", "left"), "spread")
    slim = slim.withColumn("own", node("url")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    # null urls match nothing: they are dealt over the tasks of the join
    slim = slim.withColumn("node", F.coalesce("own", F.concat(F.lit("none "), F.pmod(F.xxhash64("page_id"), F.lit(4096)).cast("string"))))
    out = slim.join(of, "node", "left")
    by = F.when(F.col("r").isNotNull(), "rule").when(F.col("spread").isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "spread", F.lit(default)).alias("verdict"), F.coalesce("component", "own").alias("component"), by.alias("decided_by"))
