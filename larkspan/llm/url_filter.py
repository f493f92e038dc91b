"""URL filters: rules by host and path, and trust and distrust that spread over the links between hosts. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import join_checked, materialise

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: A link's host: what follows `//` in an href, with or without a scheme.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Units of trust that a page gives. Scores are whole numbers, so sums don't depend on their order and reruns agree.
UNIT = 1_000_000


class Rule(NamedTuple):
    """A rule of a short list made by hand: it fits its host and the host's subdomains where the path begins with its own."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def parts(url: Column) -> tuple[Column, Column]:
    """Host, in lower case, and path; both empty where the url is null or has no `://`."""
    held = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(held, _URL, 1), _UPPER, _LOWER), F.regexp_extract(held, _URL, 2)


def ruled(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    longest = sorted(rules, key=lambda r: (-len(r.name), r.name))
    chosen = [F.when(r.fits(host, path), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in longest]
    return F.coalesce(*chosen, F.lit(None).cast("struct<rule: string, verdict: string>"))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): hosts whose pages link to another host, each pair once. Links are taken from the whole page."""
    host, _ = parts(F.col(url_col))
    links = F.transform(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER))
    return pages.select(host.alias("src"), F.explode(F.array_distinct(links)).alias("dst")).filter("src <> '' AND src <> dst").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, damping: int = 85, steps: int = 30) -> DataFrame:
    """(host, trust, distrust): personalised PageRank from the seeds (host, trust, distrust; whole numbers).

    Trust goes from a host to those that it links to, distrust from a host to those that link to it, `damping` per cent
    of what arrived in a step, in equal parts. The walk ends after `steps` steps (0.85 ** 30 is under a hundredth) or
    when nothing moves; what a host without links would pass on is lost, which scales all scores alike. PageRank is
    linear in its seeds, so they hold counts. A step is a join of the links with what moves and a sum by host, and what
    moves is written, so that lost executors cost one step. Hubs are spread: the moving side is broadcast while it is
    small and salted beyond that.
    """
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    back = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    degrees = {"src": materialise(out), "dst": materialise(back)}
    ways = [join_checked(edges, degrees[a], [a], "inner").select(F.col(a).alias("host"), F.col(b).alias("to"), "n", F.lit(a == "src").alias("forward")) for a, b in (("src", "dst"), ("dst", "src"))]
    moves = materialise(reduce(DataFrame.unionByName, ways))
    share = lambda c: F.expr(f"({c} * {damping}) div (100 * n)")
    waves = [materialise(seeds.select("host", "trust", "distrust").filter("trust > 0 OR distrust > 0"))]
    while len(waves) <= steps and not waves[-1].isEmpty() and not moves.isEmpty():
        met = join_checked(moves, waves[-1], ["host"], "inner")
        sent = met.groupBy(F.col("to").alias("host")).agg(F.sum(F.when(F.col("forward"), share("trust")).otherwise(0)).alias("trust"), F.sum(F.when(F.col("forward"), 0).otherwise(share("distrust"))).alias("distrust"))
        waves.append(materialise(sent.filter("trust > 0 OR distrust > 0")))
    return materialise(reduce(DataFrame.unionByName, waves).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))


def host_scores(pages: DataFrame, rules: list[Rule], url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """(host, trust, distrust) after propagation; a host's seed is the number of its pages that a rule allows or blocks."""
    host, path = parts(F.col(url_col))
    rule = ruled(F.col("host"), F.col("path"), rules)
    seen = pages.select(host.alias("host"), path.alias("path")).select("host", rule["verdict"].alias("verdict")).filter("host <> ''")
    units = lambda verdict: (F.count_if(F.col("verdict") == verdict) * UNIT).alias({"allow": "trust", "block": "distrust"}[verdict])
    return propagate(seen.groupBy("host").agg(units("allow"), units("block")), materialise(host_edges(pages, url_col, html_col)), **options)


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """One row a page: id, host, path, rule, verdict (allow or block).

    The longest rule that fits decides. Other pages follow their host: it is blocked if more distrust than trust has
    reached it from pages that rules decide, over the links between hosts; a host that neither reached is allowed.

    Pages are counted by host before any shuffle; only blocked hosts meet the pages again, broadcast up to a checked
    number and salted beyond it, so that one host may hold a third of all pages. Null urls and those without `://` have
    an empty host and path, fit no rule here and are allowed. Null html has no links. Repeated rows get repeated
    results; an empty table gives none. Other columns are ignored, whatever their names.
    """
    scores = host_scores(pages, rules, url_col, html_col, **options)
    blocked = materialise(scores.filter("distrust > trust").select("host", F.lit(True).alias("blocked")))
    host, path = parts(F.col(url_col))
    held = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    met = join_checked(held, blocked, ["host"]).withColumn("_rule", ruled(F.col("host"), F.col("path"), rules))
    by_host = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return met.select(F.col("id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), by_host).alias("verdict"))
