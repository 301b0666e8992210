"""URL filters that follow redirects.

Rules block or allow a host with its subdomains below a path. Pages that declare another address
(canonical links, refresh redirects) or are known to redirect are aliases: the connected components
over these links pass a block decision on to the members that no rule decides, unless a
member is explicitly allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashwave.llm.components import connected_components
from hashwave.operators.joins import splittable_join

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?is)<link\b[^>]*>"""
#: One word of the list in rel.
_CANONICAL = r"""(?is)[\s"'/]rel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?=[\s>/]))"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """``verdict`` is ``block`` or ``allow``; rules are a short list given by the caller."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none or the url is null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def matching(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits, else null; of equal length the first one given."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: -len(r.name))[::-1]:
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.lit(value(rule))).otherwise(found)
    return found


def address(url: Column) -> Column:
    """The url as a node: scheme and host in lower case, no fragment; null without ``://``."""
    bare = F.regexp_extract(url, r"^([^#]*)", 1)
    scheme = F.lower(F.substring_index(bare, "://", 1))
    after = F.substring(_rest(bare), F.length(host(bare)) + 1, F.length(bare))
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host(bare), after))


def resolved(link: Column, base: Column) -> Column:
    """A link found on a page as a full url; empty links give null."""
    scheme, site = F.substring_index(base, "://", 1), F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*", 0)
    folder = F.concat(site, F.regexp_extract(path(base), r"^(.*/)?", 0))
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(link == "", None)
        .when(F.instr(link, "://") > 0, link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path(base), link))
        .otherwise(F.concat(folder, link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Edges from pages to all the addresses that they declare by canonical links or refresh redirects."""
    tags = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    canonical = F.filter(tags(_LINK), lambda tag: tag.rlike(_CANONICAL))
    found = F.concat(
        F.transform(canonical, lambda tag: F.regexp_extract(tag, _HREF, 1)),
        F.transform(tags(_REFRESH), lambda tag: F.regexp_extract(tag, _REFRESH_URL, 1)),
    )
    links = pages.select("url", F.explode(F.filter(found, lambda link: link != "")).alias("link"))
    full = resolved(F.replace("link", F.lit("&amp;"), F.lit("&")), F.col("url"))
    return edges(links.select("url", _once(full).alias("link")))


def _once(value: Column) -> Column:
    """The value as generated row, so that filters above use it instead of repeating its expression."""
    return F.explode(F.array(value))


def edges(links: DataFrame) -> DataFrame:
    """(from, to) as addresses for pairs of urls, without loops."""
    source, target = links.columns
    ends = F.struct(address(F.col(source)).alias("from"), address(F.col(target)).alias("to"))
    return links.select(_once(ends).alias("_ends")).select("_ends.from", "_ends.to").where("`from` != `to`")


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to pages with ``url`` and ``html``.

    ``redirects`` may name further (from, to) pairs of urls. A page that a rule fits gets that
    rule's verdict. Another page is blocked if an alias is blocked by rule and none is allowed by
    rule, else allowed. A null url or one without ``://`` has empty host and path, no rule and no aliases.
    Repeated pages are judged alike; columns of these four names are replaced.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(edges(redirects.toDF("source", "target")))
    members = connected_components(links)
    members = members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
    verdict = lambda url: matching(rules, host(url), path(url), lambda r: r.verdict)
    decided = members.groupBy("component").agg(
        F.max(F.coalesce(verdict(F.col("node")) == "block", F.lit(False))).alias("_blocked"),
        F.max(F.coalesce(verdict(F.col("node")) == "allow", F.lit(False))).alias("_allowed"),
    )
    blocked = decided.where("_blocked and not _allowed").select("component")
    aliases = members.join(blocked, "component", "left_semi").select(F.col("node").alias("_node"), F.lit(True).alias("_alias"))
    url = F.col("url")
    ruled = pages.withColumns(
        {
            "_node": address(url),
            "host": host(url),
            "path": path(url),
            "rule": matching(rules, host(url), path(url), lambda r: r.name),
            "verdict": verdict(url),
        }
    )
    passed_on = F.when(F.col("_alias"), F.lit("block")).otherwise(F.lit("allow"))
    return (
        splittable_join(ruled, aliases, ["_node"], "left")
        .withColumn("verdict", F.coalesce("verdict", passed_on))
        .drop("_node", "_alias")
    )
