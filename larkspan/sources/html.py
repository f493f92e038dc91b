"""Readers of event data inside pages: structured data, hydration state, feeds, calendars and selectors, and the waterfall over them."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.text import collapse, decode_entities, first_match, strip_tags
from larkspan.sources import structured
from larkspan.sources.structured import CARD

_FIELDS = ("title", "date", "location", "description", "detail_url", "image_url")
STRATEGIES = ("hydration", "json_ld", "microdata", "feed", "dom")
_VOID = {"meta", "link", "img", "br", "input", "hr", "source", "area", "base", "col", "embed", "track", "wbr"}


class _Cards(HTMLParser):
    """Blocks whose class names an event: the first heading, date, place, link and image in each."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.begin, self.card, self.into = 0, 0, None, None
        self.cards: list[dict] = []

    def handle_starttag(self, tag, attrs):
        a, names = dict(attrs), f"{dict(attrs).get('class') or ''}".lower()
        if tag in _VOID:
            if tag == "img" and self.card is not None and a.get("src"):
                self.card.setdefault("image_url", a["src"])
            return
        self.depth += 1
        if self.card is None and tag in ("article", "li", "div", "section") and re.search(r"\b(event|agenda|calendar|listing)[\w-]*", names):
            self.card, self.begin = {}, self.depth
        elif self.card is not None:
            if tag in ("h1", "h2", "h3", "h4") or "title" in names:
                self.into = "title"
            elif tag == "time" or "date" in names:
                self.into = "date"
                if a.get("datetime"):
                    self.card.setdefault("date", a["datetime"])
            elif re.search("venue|location|place", names):
                self.into = "location"
            elif tag == "p" or "desc" in names:
                self.into = "description"
            if tag == "a" and a.get("href"):
                self.card.setdefault("detail_url", a["href"])

    def handle_endtag(self, tag):
        if tag in _VOID:
            return
        if self.card is not None and self.depth == self.begin:
            if self.card.get("title"):
                self.cards.append({f: self.card.get(f) for f in _FIELDS})
            self.card = None
        self.depth, self.into = self.depth - 1, None if tag not in ("a", "span", "strong", "em", "b") else self.into

    def handle_data(self, data):
        if self.card is not None and self.into and data.strip():
            self.card.setdefault(self.into, data.strip())


def dom(page: str) -> list[dict]:
    parser = _Cards()
    parser.feed(page)
    return parser.cards


def dom_cards(page: Column) -> Column:
    """Cards by class names, which need the page's tree; pages that are null are not parsed."""

    @F.pandas_udf(f"array<{CARD}>")
    def read(pages: pd.Series) -> pd.Series:
        return pd.Series([[{f: c.get(f) for f in _FIELDS} for c in dom(page)] if isinstance(page, str) else [] for page in pages])

    return read(page)


def waterfall(pages: DataFrame, key: str, html: str, order: tuple[str, ...] = STRATEGIES, preferred: str | None = None) -> DataFrame:
    """key, strategy, cards, trace: strategies in order until one finds a card; the trace tells what each found.

    The preferred strategy comes first. Structured data is read by expressions; only pages in which what comes before
    the selectors found nothing go through a parser. Pages aren't shuffled. Null pages have no cards and no trace.
    """
    steps = [preferred, *[s for s in order if s != preferred]] if preferred else list(order)
    native = {"hydration": structured.hydration, "json_ld": structured.json_ld, "microdata": structured.microdata, "feed": structured.feed}
    at = steps.index("dom") if "dom" in steps else len(steps)
    found = lambda names: F.array(*[F.struct(F.lit(n).alias("strategy"), native[n](F.col(html)).alias("cards")) for n in names])
    none = F.array().cast(f"array<struct<strategy:string,cards:array<{CARD}>>>")
    read = pages.withColumn("_found", found(steps[:at]) if at else none)
    if at < len(steps):
        open_ = ~F.exists("_found", lambda x: F.size(x["cards"]) > 0)
        read = read.withColumn("_dom", dom_cards(F.when(open_, F.col(html))))
        last = F.array(F.struct(F.lit("dom").alias("strategy"), F.col("_dom").alias("cards")))
        read = read.withColumn("_found", F.concat("_found", last, found(steps[at + 1 :]) if at + 1 < len(steps) else none))

    def result(all_: Column) -> Column:
        won = F.array_position(F.transform(all_, lambda x: F.size(x["cards"]) > 0), True).cast("int")
        best = F.when(won > 0, F.get(all_, won - 1))
        trace = F.transform(F.slice(all_, 1, F.when(won > 0, won).otherwise(len(steps))), lambda x: F.struct(x["strategy"].alias("strategy"), F.size(x["cards"]).alias("found")))
        return F.struct(best["strategy"].alias("strategy"), F.coalesce(best["cards"], F.array().cast(f"array<{CARD}>")).alias("cards"), trace.alias("trace"))

    nothing = F.struct(F.lit(None).cast("string").alias("strategy"), F.array().cast(f"array<{CARD}>").alias("cards"), F.array().cast("array<struct<strategy:string,found:int>>").alias("trace"))
    shown = F.when(F.col(html).isNull(), nothing).otherwise(F.element_at(F.transform(F.array("_found"), result), 1))
    return read.select(key, shown.alias("_read")).select(key, "_read.*")


def calendar_events(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Events of iCalendar texts: key, ordinal, summary, start, end, location, description, url. Lines aren't unfolded."""
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"), F.lit(1))
    field = lambda name: first_match(F.col("block"), rf"(?mi)^{name}[^:\r\n]*:([^\r\n]*)")
    out = documents.select(key, F.posexplode(blocks).alias("ordinal", "block"))
    return out.select(key, "ordinal", field("SUMMARY").alias("summary"), field("DTSTART").alias("start"), field("DTEND").alias("end"), field("LOCATION").alias("location"), field("DESCRIPTION").alias("description"), field("URL").alias("url"))


def _escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def calendar_text(uid: Column, title: Column, start: Column, end: Column, location: Column, description: Column) -> Column:
    """An iCalendar text of one event, times in UTC."""
    stamp = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss'Z'")
    return F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTART:"), stamp(start)), F.concat(F.lit("DTEND:"), stamp(end)), F.concat(F.lit("SUMMARY:"), _escaped(title)), F.concat(F.lit("LOCATION:"), _escaped(location)), F.concat(F.lit("DESCRIPTION:"), _escaped(description)), F.lit("END:VEVENT"), F.lit("END:VCALENDAR"))


#: Signs of a page's framework and their weights, in order; the first of the best wins.
FRAMEWORKS: dict[str, list[tuple[str, int]]] = {
    "next.js": [(r"window\.__NEXT_DATA__\s*=", 95), ("_next/static", 80), (r'<script\s+id="__NEXT_DATA__"', 95), ("next/router", 70), (r'"buildId"\s*:\s*"[^"]+"', 75)],
    "nuxt": [(r"window\.__NUXT__\s*=", 95), ("_nuxt/", 80), (r"nuxt\.js", 70)],
    "react": [(r"window\.__INITIAL_STATE__\s*=", 90), (r"window\.__PRELOADED_STATE__\s*=", 90), (r"window\.__APP_DATA__\s*=", 85), ("data-reactroot", 70), (r"react\.production\.min\.js", 65), ("__react_", 60)],
    "wix": [(r"wix\.com", 80), (r"wixstatic\.com", 90), (r"window\.wixBiSession", 95), ("wix-code-sdk", 85), (r"viewer\.wix", 90)],
    "squarespace": [(r"squarespace\.com", 85), (r"static\.squarespace\.com", 90), (r"Squarespace\.Constants", 95), ("sqs-", 70)],
    "wordpress": [(r"<meta\s+name=[\"']generator[\"']\s+content=[\"']WordPress[^\"']*[\"']", 95), ("wp-content/", 80), ("wp-includes/", 80), ("wp-json/", 85), (r"/feed/?[\"'\s>]", 60), ("the-events-calendar", 75), ("tribe-events", 75)],
    "drupal": [(r"<meta\s+name=[\"']Generator[\"']\s+content=[\"']Drupal[^\"']*[\"']", 95), ("/sites/default/files/", 75), (r"drupal\.js", 80), (r"Drupal\.settings", 90)],
    "joomla": [(r"<meta\s+name=[\"']generator[\"']\s+content=[\"']Joomla[^\"']*[\"']", 95), ("/media/jui/", 80), ("/components/com_", 75)],
    "shopify": [(r"cdn\.shopify\.com", 90), (r"Shopify\.theme", 95), ("//cdn\\.shopify", 85)],
    "webflow": [(r"webflow\.com", 80), (r"assets\.website-files\.com", 90), ("w-webflow-badge", 85)],
}


def framework(html: Column) -> Column:
    """struct<cms, confidence>: the framework with the greatest sum of weights, half of it as confidence up to 100."""
    scores = [(name, sum((F.when(html.rlike(p), w).otherwise(0) for p, w in signs), F.lit(0))) for name, signs in FRAMEWORKS.items()]
    best = F.greatest(*[s for _, s in scores])
    name = F.coalesce(*[F.when((s == best) & (best > 0), n) for n, s in scores], F.lit("unknown"))
    return F.struct(name.alias("cms"), F.least(F.lit(100), F.round(best * 0.5)).cast("int").alias("confidence"))


def links(pages: DataFrame, key: str, url: str, html: str, allowed: str = r"(?i)/(event|events|agenda|calendar|activit|concert|show|program)", most: int = 50) -> DataFrame:
    """Links of each page to its own site whose path names events: key, rank, link; no files, at most `most`, in order."""
    from pyspark.sql import Window

    from larkspan.functions.text import canonical_url, domain, resolve_url, without_tracking

    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)href=["']([^"'#]+)["']"""), F.lit(1))
    rows = pages.select(key, F.col(url).alias("_base"), F.posexplode(found).alias("_at", "_href"))
    rows = rows.withColumn("link", canonical_url(without_tracking(resolve_url(decode_entities(F.col("_href")), F.col("_base")))))
    kept = rows.filter((domain(F.col("link")) == domain(F.col("_base"))) & F.col("link").rlike(allowed) & ~F.col("link").rlike(r"(?i)\.(jpg|jpeg|png|gif|svg|css|js|pdf|zip|ico|webp)(\?|$)"))
    firsts = kept.groupBy(key, "link").agg(F.min("_at").alias("_at"))
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("_at", "link"))).filter(F.col("rank") <= most).select(key, "rank", "link")


def best_image(html: Column) -> Column:
    """The page's picture: OpenGraph, Twitter, then the first image that is no pixel or icon."""
    meta = lambda name: first_match(html, rf"""(?i)<meta[^>]+(?:property|name)=["']{name}["'][^>]+content=["']([^"']+)["']""", rf"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+(?:property|name)=["']{name}["']""")
    images = F.filter(F.regexp_extract_all(html, F.lit(r"""(?i)<img[^>]+src=["']([^"']+)["']"""), F.lit(1)), lambda u: ~u.rlike("(?i)pixel|track|beacon|1x1|spacer|logo|icon|avatar|data:"))
    return F.coalesce(meta("og:image"), meta("twitter:image"), F.get(images, F.lit(0)))


def page_facts(html: Column) -> Column:
    """struct<title, heading, words, tracking>: the first heading or title, and the words of the text without tags."""
    title = collapse(decode_entities(strip_tags(first_match(html, r"(?is)<title[^>]*>(.*?)</title>"))))
    heading = collapse(decode_entities(strip_tags(first_match(html, r"(?is)<h1[^>]*>(.*?)</h1>"))))
    body = strip_tags(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "))
    return F.struct(title.alias("title"), heading.alias("heading"), F.size(F.filter(F.split(body, " "), lambda w: w != "")).alias("words"))


def search_queries(cities: DataFrame, templates: list[str]) -> DataFrame:
    """Each city with each template, {city} filled in: an explode of a literal list, so no join."""
    return cities.select("city", F.explode(F.array(*[F.lit(t) for t in templates])).alias("template")).withColumn("query", F.replace("template", F.lit("{city}"), F.col("city")))
