"""URL filters: rules, and block decisions passed on along redirects and canonical links."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerline.llm.components import connected_components
from careerline.llm.storage import stored

Rule = tuple[str, str, str]
#: Up to so many rules are tried one by one on each url; more are joined by host.
INLINE_RULES = 64

_AUTHORITY = r"://([^/?#]*)([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"""(?is)^<link\b[^>]*\brel\s*=\s*["']?\s*canonical\b"""
_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_BASE = r"(?is)<base\b[^>]*>"
_REFRESH = r"""(?is)^<meta\b[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b"""
_REFRESH_URL = r"""(?is)\bcontent\s*=\s*["']?\s*[\d.]+\s*[;,]\s*(?:url\s*=\s*)?["']?\s*([^"'>\s]+)"""

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+);"
# The named character references that urls are written with.
_NAMED = {
    "amp": "&", "AMP": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "sol": "/", "colon": ":", "period": ".", "quest": "?",
    "num": "#", "equals": "=", "percnt": "%", "lowbar": "_", "plus": "+", "comma": ",", "semi": ";", "excl": "!", "commat": "@",
}


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _AUTHORITY, 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, _AUTHORITY, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """One name for urls that servers commonly redirect to one another: scheme, fragment and a
    slash at the path's end are left out. NULL where there is no host."""
    query = F.regexp_extract(url, r"\?[^#]*", 0)
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.regexp_replace(without_dots(path_of(url)), "/+$", ""), query))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value's expression held once in the plan, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` segments are resolved; ``..`` does not lead above the root."""
    return F.when(path.rlike(r"(?i)/(\.|%2e)"), _let(F.split(path, "/", -1), _joined)).otherwise(path)


def _joined(parts: Column) -> Column:
    named = lambda part: F.regexp_replace(part, "(?i)%2e", ".")
    # The first part is empty, as paths start with a slash.
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda found, part: F.when(named(part) == ".", found)
        .when(named(part) == "..", F.slice(found, F.lit(1), F.greatest(F.lit(1), F.size(found) - 1)))
        .otherwise(F.concat(found, F.array(part))),
    )
    folder = F.when(named(F.element_at(parts, -1)).isin(".", ".."), "/").otherwise("")
    return F.concat(F.array_join(kept, "/"), folder)


def decoded(text: Column) -> Column:
    """Numeric and the usual named character references replaced by their characters; others stay."""

    known = F.create_map(*(F.lit(x) for pair in _NAMED.items() for x in pair))
    valid = lambda code: F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), code)
    char = lambda code: F.decode(F.unhex(F.lpad(F.hex(valid(code)), 8, "0")), "UTF-32")

    def named(name: Column) -> Column:
        code = F.when(name.rlike("^#[xX]"), F.conv(name.substr(3, 6), 16, 10)).when(name.startswith("#"), name.substr(2, 7))
        return F.coalesce(_let(code.cast("long"), char), F.try_element_at(known, name))

    def plain(part: Column) -> Column:
        found = _let(F.regexp_extract(part, _REFERENCE, 1), named)
        return F.coalesce(F.concat(found, F.regexp_replace(part, _REFERENCE, "")), F.concat(F.lit("&"), part))

    whole = lambda parts: F.array_join(
        F.transform(parts, lambda part, k: F.when(k == 0, part).otherwise(plain(part))), ""
    )
    return _let(text, lambda x: F.when(x.contains("&"), _let(F.split(x, "&", -1), whole)).otherwise(x))


def absolute(target: Column, url: Column) -> Column:
    """A link's target seen from the page at ``url``, without dot segments; NULL if it stays on the page or has no host."""
    found = _let(target, lambda target: _let(url, lambda url: _joined_to(target, url)))
    cleaned = lambda x: F.concat(
        F.regexp_extract(x, r"^[^/?#]*//[^/?#]*", 0), _let(path_of(x), without_dots), F.regexp_extract(x, r"(?s)[?#].*", 0)
    )
    return _let(found, lambda x: F.when(x.isNotNull(), cleaned(x)))


def _joined_to(target: Column, url: Column) -> Column:
    scheme = F.regexp_extract(url, r"^[^:/?#]*", 0)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_replace(path_of(url), "[^/]*$", "")
    return (
        F.when((target == "") | target.startswith("#"), F.lit(None))
        .when(target.rlike(_SCHEME + "//"), target)
        .when(target.rlike(_SCHEME), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path_of(url), target))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )


def _href(tag: Column) -> Column:
    return F.concat(*(F.coalesce(F.regexp_extract(tag, _HREF, k), F.lit("")) for k in (1, 2, 3)))


def alias_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``url`` and ``target`` (absolute) of each page's canonical links and immediate redirects.

    Targets are seen from the page's first base element with a target, or else from the page.
    """
    tags = F.regexp_extract_all(F.col(html), F.lit(_TAG), F.lit(0))
    bases = F.transform(F.regexp_extract_all(F.col(html), F.lit(_BASE), F.lit(0)), lambda tag: F.trim(decoded(_href(tag))))
    base = absolute(F.get(F.filter(bases, lambda x: x != ""), F.lit(0)), F.col(url))
    named = pages.where(F.col(html).rlike("(?i)canonical|refresh") & (host_of(F.col(url)) != ""))
    tag = F.col("__tag")
    seen = F.coalesce(base, F.col(url)).alias("__from")
    links = named.select(F.col(url).alias("url"), seen, F.explode(tags).alias("__tag")).select(
        "url", "__from", F.when(tag.rlike(_CANONICAL), _href(tag)).when(tag.rlike(_REFRESH), F.regexp_extract(tag, _REFRESH_URL, 1)).alias("target")
    )
    target = absolute(F.trim(decoded(F.col("target"))), F.col("__from"))
    return links.where(F.col("target").isNotNull()).select("url", target.alias("target")).where("target IS NOT NULL")


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    under = (host == rule_host) | host.endswith(F.concat(F.lit("."), rule_host))
    return under & path.startswith(rule_path)


def with_rules(urls: DataFrame, rules: Sequence[Rule], inline: int = INLINE_RULES) -> DataFrame:
    """Adds ``decision``: the ``rule`` and its ``own`` verdict that fit ``host`` and ``path``, or NULL.

    The longest rule wins, and allow before block among equal ones. Few rules are tried in order of
    their length without a shuffle; many are joined to the domains above each distinct host.
    """
    for verdict, _, _ in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks, it cannot {verdict}")
    ranked = sorted({*rules}, key=lambda r: (-len(r[1] + r[2]), r[0], r[1]))
    decision = lambda verdict, name: F.struct(name.alias("rule"), verdict.alias("own"))
    host, path = F.col("host"), F.col("path")
    if len(ranked) <= inline:
        chosen = F.lit(None).cast("struct<rule:string,own:string>")
        for verdict, rule_host, rule_path in reversed(ranked):
            chosen = F.when(
                _fits(host, path, F.lit(rule_host), F.lit(rule_path)), decision(F.lit(verdict), F.lit(rule_host + rule_path))
            ).otherwise(chosen)
        return urls.withColumn("decision", chosen)
    spark = urls.sparkSession
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(ranked)], "place int, verdict string, domain string, prefix string")
    labels = F.split("host", r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    places = urls.select("host", "path").distinct()
    above = places.withColumn("domain", F.explode(domains)).join(table, "domain").where(F.col("path").startswith(F.col("prefix")))
    best = above.groupBy("host", "path").agg(
        F.min_by(decision(F.col("verdict"), F.concat("domain", "prefix")), "place").alias("decision")
    )
    return urls.join(best, ["host", "path"], "left")


def judge(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key``, ``url``, ``host``, ``path``, ``rule`` and ``verdict`` of every page.

    A page that a rule fits has the rule's verdict, whatever its aliases have. Any other page is blocked if one
    of its aliases is blocked by a rule and none is allowed by one; else it is allowed. Aliases are all pages and link
    targets that canonical links, redirects and the common redirects of :func:`node_of` connect, over any
    number of steps. Pages without a host have no aliases. NULL html has no links; repeated rows are judged alike.
    """
    plain = pages.select(F.col(key).alias("__key"), F.col(url).alias("url"))
    placed = plain.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = with_rules(placed, rules).select("*", node_of(F.col("url")).alias("node"))
    judged = stored(judged.select("__key", "url", "host", "path", "node", "decision.rule", "decision.own"))
    links = stored(alias_links(pages, url, html))
    targets = links.select("target").distinct()
    targets = targets.select("target", host_of(F.col("target")).alias("host"), path_of(F.col("target")).alias("path"))
    targets = with_rules(targets, rules).select(node_of(F.col("target")).alias("node"), F.col("decision.own").alias("own"))
    ends = links.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))
    members = stored(connected_components(ends, "a", "b"))
    ruled = judged.select("node", "own").unionByName(targets).where("own IS NOT NULL AND node IS NOT NULL")
    root = F.coalesce("component", "node")
    blocked = (
        ruled.groupBy("node")
        .agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
        .join(members, "node", "left")
        .groupBy(root.alias("root"))
        .agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
        .where("blocked AND NOT allowed")
    )
    blocked = stored(blocked.select("root", F.lit("block").alias("passed")))
    open_ = judged.where("own IS NULL").join(members, "node", "left").withColumn("root", root)
    passed = open_.join(blocked, "root", "left").withColumn("verdict", F.coalesce("passed", F.lit("allow")))
    columns = [F.col("__key").alias(key), "url", "host", "path", "rule", "verdict"]
    own = judged.where("own IS NOT NULL").withColumn("verdict", F.col("own"))
    return own.select(*columns).unionByName(passed.select(*columns))
