"""URL filters [native]: rules for hosts and paths, with redirect equivalence.

Pages that redirect or canonical links join into one class share decisions: an explicit rule
of a page's own url always holds; a page without one is allowed if any alias of its class is
explicitly allowed, else blocked if any alias is blocked, else allowed. Classes are connected
components over canonical keys of urls (scheme, query, fragment, trailing slash and ``.html``
do not tell pages apart) joined by the canonical and refresh links found in the html. Both ends of
a link are aliases, whether or not they are pages themselves.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule,
has no aliases and is allowed. Of rules of one length that fit, the first by its text counts. A null
html has no links; a very long one is searched whole. An empty table gives no rows; repeated rows each
get their row; a null page_id is a row like any other. Extra columns are not read.
Everything runs in DataFrame functions; nothing is broadcast but a rule list of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
MOST_RULES = 1000
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), _UP, _LOW)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def key_of(url: Column) -> Column:
    """The canonical form of a url; null where the url has no host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), r"(?:\.html?|/index\.html?|/)$", "")))


def _fits(host: Column, path: Column, rule: str) -> Column:
    name, slash, rest = rule.partition("/")
    ours = (host == name) | host.endswith("." + name)
    return ours & path.startswith(slash + rest)


def judge(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        fits = _fits(host, path, text)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def resolved(base: Column, to: Column) -> Column:
    """The url that a link's target names on a page; null where it names none (another scheme, or a base without a host)."""
    origin = F.concat(F.regexp_extract(base, "^(.*?)://", 1), F.lit("://"), F.regexp_extract(_after(base), "^[^/?#]*", 0))
    here = path_of(base)
    rest = F.regexp_extract(to, "^[^?#]*", 0)
    path = F.when(rest == "", here).when(rest.startswith("/"), rest).otherwise(F.concat(F.when(here == "", "/").otherwise(F.regexp_replace(here, "[^/]*$", "")), rest))
    # "." and ".." go; a path that ends in one ends in a slash
    parts = F.split(F.regexp_replace(path, r"(/\.\.?)$", "$1/"), "/")
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x)))
    whole = F.concat(origin, F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    relative = F.when(host_of(base) != "", F.when(to.startswith("//"), F.concat(F.regexp_extract(base, "^(.*?)://", 1), F.lit(":"), to)).otherwise(whole))
    return F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(~to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), relative)


def links_of(pages: DataFrame) -> DataFrame:
    """(a, b): a page's url and the target of each canonical link and refresh redirect in its html.

    Tags in comments are none; relative targets follow the page's url, or its html's base."""
    html = F.regexp_replace("html", "(?s)<!--.*?-->", "")
    tags = pages.filter(key_of(F.col("url")).isNotNull() & F.col("html").rlike(f"{_LINK}|{_REFRESH}")).select(F.col("url").alias("a"), html.alias("html"))
    of = lambda tag, name: F.transform(F.regexp_extract_all("html", F.lit(tag), 0),
        lambda t: F.regexp_extract(t, rf"""(?i)\b{name}\s*=\s*["']?([^"'\s>]+)""", 1))
    base = F.regexp_extract("html", r"""(?i)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    found = tags.select("a", F.when(base == "", F.col("a")).otherwise(F.coalesce(resolved(F.col("a"), base),
        "a")).alias("base"), F.explode(F.concat(of(_LINK, "href"), of(_REFRESH, "url"))).alias("to"))
    return found.filter("to <> ''").select("a", resolved(F.col("base"), F.col("to")).alias("b")).filter("b is not null")


def filter_urls(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict; ``edges`` (a, b) holds further redirects between urls."""
    url = F.col("url")
    host, path = host_of(url), path_of(url)
    rows = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), key_of(url).alias("key"))
    rule, own = judge(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "own": own})
    links = links_of(pages)
    if edges is not None:
        links = links.unionByName(edges.select("a", "b"))
    links = materialize(links.distinct(), "links").filter(key_of(F.col("a")).isNotNull() & key_of(F.col("b")).isNotNull())
    classes = connected_components(links.select(key_of(F.col("a")).alias("a"), key_of(F.col("b")).alias("b")))
    # Both ends of a link are judged by their own host and path, whether or not they are pages.
    ends = links.select(F.explode(F.array("a", "b")).alias("url")).distinct()
    ends = ends.select(key_of(url).alias("key"), judge(host, path, rules)[1].alias("own"), F.lit(False).alias("page"))
    judged = rows.filter("key is not null").select("key", "own", F.lit(True).alias("page")).unionByName(ends)
    keys = judged.groupBy("key").agg(
        F.max((F.col("own") == "block").cast("int")).alias("block"), F.max((F.col("own") == "allow").cast("int")).alias("allow"),
            F.max((F.col("own").isNull() & F.col("page")).cast("int")).alias("open")
    )
    # Keys without links are classes of their own; only classes that block and still have open members matter below.
    keys = keys.join(classes, keys.key == classes.node, "left").select("key", F.coalesce("component", "key").alias("top"), "block", "allow", "open")
    tops = keys.groupBy("top").agg(F.max("block").alias("block"), F.max("allow").alias("allow"), F.max("open").alias("open"))
    tops = tops.filter("block = 1 and coalesce(allow, 0) = 0 and open = 1").select("top")
    blocked = materialize(keys.join(tops, "top", "left_semi").select("key", F.lit("block").alias("shared")), "blocked")
    out = rows.join(blocked, "key", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "shared", F.lit("allow")).alias("verdict"))
