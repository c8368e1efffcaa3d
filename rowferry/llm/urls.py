"""URL filter with redirect equivalence: rules judge a URL, and a block spreads to its aliases unless one is allowed.

Aliases are URLs tied by canonical links and refresh redirects found in pages,
or that differ only in scheme, a leading ``www.``, fragment, closing slash or
tracking parameters. They are the connected components of those ties.

Nulls: a null url, or one without ``://``, has empty host and path, fits no
rule and has no alias: allowed. A null html has no links. Repeated rows are
judged each. Of rules that fit equally long an allowing one wins, then the
first by name. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rowferry.llm.components import connected_components
from rowferry.session import Staged


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str


RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|sid|session)=[^&]*"
_ATTRIBUTE = r"""\s*=\s*["']?\s*([^"'\s>]+)"""
_CANONICAL = rf"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref{_ATTRIBUTE}"
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; null where none does. Rules are a short given list."""
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(len(r.host + r.path)).alias("size"), F.lit(int(r.verdict == "allow")).alias("open"), F.lit(-i).alias("nth"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for i, r in enumerate(sorted(rules, key=lambda r: r.host + r.path))
    ]
    if not fits:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def alias_key(url: Column) -> Column:
    """The name under which equal pages meet: host and path without what does not change the page; null without a host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(?:80|443)$", ""), r"^www\.", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.sort_array(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("(?i)^" + TRACKING + "$"))), "&")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def absolute(link: Column, url: Column) -> Column:
    """A link as a whole URL; relative ones without a leading slash are taken from the page's folder."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row."""
    url, html = F.col("url"), F.coalesce(F.col("html"), F.lit(""))
    links = F.concat(F.regexp_extract_all(html, F.lit(_CANONICAL), F.lit(1)), F.regexp_extract_all(html, F.lit(_REFRESH), F.lit(1)))
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), alias_key(url).alias("key"), F.array_distinct(F.filter(links, lambda x: x != "")).alias("links"))
    held = Staged(rows.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)).select("page_id", "url", "host", "path", "key", "links", "fit.rule", "fit.verdict"), "pages").df
    ties = held.where(F.col("key").isNotNull()).select("key", "url", F.explode("links").alias("link")).select("key", absolute(F.col("link"), F.col("url")).alias("to"))
    ties = ties.select("key", alias_key(F.col("to")).alias("to_key"), rule_for(host_of(F.col("to")), path_of(F.col("to")), rules)["verdict"].alias("verdict")).where(F.col("to_key").isNotNull())
    roots = connected_components(ties, "key", "to_key")
    said = held.select("key", "verdict").union(ties.select(F.col("to_key").alias("key"), "verdict")).where(F.col("key").isNotNull() & F.col("verdict").isNotNull())
    # Verdicts of one key first, then of one component: both aggregates combine map-side.
    flags = (F.max((F.col("verdict") == "allow").cast("int")).alias("opened"), F.max((F.col("verdict") == "block").cast("int")).alias("blocked"))
    by_key = said.groupBy("key").agg(*flags)
    group = F.coalesce(F.col("root"), F.col("key"))
    rooted = by_key.join(roots.withColumnRenamed("node", "key"), "key", "left").select(group.alias("group"), "opened", "blocked")
    by_group = rooted.groupBy("group").agg(F.max("opened").alias("opened"), F.max("blocked").alias("blocked"))
    spread = by_group.where((F.col("blocked") == 1) & (F.col("opened") == 0)).select("group", F.lit("block").alias("spread"))
    out = held.join(roots.withColumnRenamed("node", "key"), "key", "left").select("page_id", "host", "path", "rule", "verdict", group.alias("group"))
    out = out.join(spread, "group", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "spread", F.lit("allow")).alias("verdict"))
