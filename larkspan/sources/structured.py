"""Event cards from structured data in pages, as column expressions: JSON-LD, hydration state, microdata and feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.text import decode_entities

CARD = "struct<title:string,date:string,location:string,description:string,detail_url:string,image_url:string>"
#: Objects are searched this many levels down.
LEVELS = 10

#: Where a card's fields stand in structured data, in order of preference.
TITLE, DATE = ("title", "name", "headline"), ("startDate", "date", "start_date", "start", "datetime")
PLACE, DESCRIPTION = ("location", "venue"), ("description", "summary")
LINK, IMAGE = ("url", "link", "permalink"), ("image", "imageUrl", "thumbnail")

_LD = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
_NEXT = r"""(?s)<script[^>]*id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""
_WINDOW = r"(?s)window\.__(?:NUXT|INITIAL_STATE|PRELOADED_STATE|APP_DATA)__\s*=\s*(\{.*?\})\s*;?\s*</script>"
_EVENT = r"""(?:Event|Festival)$"""


def _parsed(text: Column) -> Column:
    """JSON as a variant, with comments, trailing commas and line feeds mended where it needs that; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/|<!--|-->", ""), r"[\t\r\n]", " ")
    mended = F.regexp_replace(F.regexp_replace(bare, r",\s*([}\]])", "$1"), r"\s*;\s*$", "")
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(mended))


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _scalar(v: Column, path: str) -> Column:
    plain = ~F.schema_of_variant(_get(v, path)).rlike("^(OBJECT|ARRAY|VOID)")
    return F.when(plain, F.nullif(_get(v, path, "string"), F.lit("")))


def _text(v: Column, names: tuple[str, ...]) -> Column:
    """The first of the fields that holds a text: itself, its name, url or @value, or that of its first element."""
    paths = [f'$["{n}"]{first}{inner}' for n in names for first in ("", "[0]") for inner in ("", '["name"]', '["url"]', '["@value"]')]
    return F.coalesce(*[_scalar(v, p) for p in paths])


def _card(v: Column) -> Column:
    fields = {"title": TITLE, "date": DATE, "location": PLACE, "description": DESCRIPTION, "detail_url": LINK, "image_url": IMAGE}
    return F.struct(*[_text(v, names).alias(name) for name, names in fields.items()])


def _elements(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _is_event_card(v: Column) -> Column:
    return _text(v, TITLE).isNotNull() & F.coalesce(_text(v, DATE), _text(v, PLACE)).isNotNull()


def hydration(page: Column) -> Column:
    """Cards of the state that a page's scripts carry: objects with a title and a date or place; none is searched below such an object.

    An object's members are visited in the order of their names.
    """
    blocks = F.concat(F.regexp_extract_all(page, F.lit(_NEXT), F.lit(1)), F.regexp_extract_all(page, F.lit(_WINDOW), F.lit(1)))
    roots = F.filter(F.transform(blocks, _parsed), lambda v: v.isNotNull())

    def below(v: Column) -> Column:
        members = F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
        return F.when(_is(v, "ARRAY"), _elements(v)).when(_is(v, "OBJECT"), F.when(_is_event_card(v), F.array(v)).otherwise(members)).otherwise(F.array().cast("array<variant>"))

    reached = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), roots, lambda nodes, _: F.flatten(F.transform(nodes, below)))
    return F.transform(F.filter(reached, lambda v: _is(v, "OBJECT") & _is_event_card(v)), _card)


def json_ld_nodes(page: Column) -> Column:
    """All objects of a page's JSON-LD as variants, also those in graphs and item lists, level by level."""
    blocks = F.regexp_extract_all(page, F.lit(_LD), F.lit(1))
    unquoted = F.transform(blocks, lambda b: F.when(b.contains("&quot;"), decode_entities(b)).otherwise(b))
    roots = F.filter(F.transform(unquoted, _parsed), lambda v: v.isNotNull())

    def opened(v: Column) -> Column:
        """The elements of a list, or the object itself."""
        return F.when(_is(v, "ARRAY"), _elements(v)).otherwise(F.array(v))

    def below(v: Column) -> Column:
        listed = F.transform(_elements(_get(v, "$.itemListElement")), lambda e: F.coalesce(_get(e, "$.item"), e))
        graph = _get(v, '$["@graph"]')
        return F.concat(F.when(graph.isNotNull(), opened(graph)).otherwise(F.array().cast("array<variant>")), listed)

    def deeper(state: Column, _: Column) -> Column:
        level = F.filter(F.flatten(F.transform(state["level"], opened)), lambda v: _is(v, "OBJECT"))
        return F.struct(F.flatten(F.transform(level, below)).alias("level"), F.concat(state["seen"], level).alias("seen"))

    start = F.struct(roots.alias("level"), F.array().cast("array<variant>").alias("seen"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), start, deeper, lambda state: state["seen"])


def json_ld(page: Column) -> Column:
    """Cards of the objects of an Event or Festival type in JSON-LD."""

    def is_event(v: Column) -> Column:
        kinds = F.coalesce(F.try_variant_get(v, '$["@type"]', "array<string>"), F.array(F.try_variant_get(v, '$["@type"]', "string")))
        return F.exists(kinds, lambda k: F.coalesce(k.rlike(_EVENT), F.lit(False)))

    return F.filter(F.transform(F.filter(json_ld_nodes(page), is_event), _card), lambda c: c["title"].isNotNull())


def _filled(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def microdata(page: Column) -> Column:
    """Cards of items of a schema.org Event type: each property's first value between an item's tag and the next item's.

    A value is the tag's content or datetime, else its target, else the first text after it.
    """
    item = r"""(?is)<[^>]*\bitemscope\b[^>]*\bitemtype=["'][^"']*schema\.org/\w*(?:Event|Festival)["'][^>]*>"""
    parts = F.split(F.regexp_replace(page, item, "\u0001"), "\u0001")
    items = F.when(F.size(parts) > 1, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))

    def field(part: Column, names: tuple[str, ...]) -> Column:
        found = []
        for name in names:
            tag = F.regexp_extract(part, rf"""(?is)<\w+[^>]*\bitemprop=["']{name}["'][^>]*>(?:\s*<[^>]+>)*\s*[^<]*""", 0)
            own = F.regexp_extract(tag, "(?s)^<[^>]*>", 0)
            attribute = lambda a: _filled(F.regexp_extract(own, rf"""(?i)\b{a}=["']([^"']*)["']""", 1))  # noqa: B023,E731
            text = F.regexp_extract(tag, r"(?s)^(?:\s*<[^>]+>)*\s*([^<]*)", 1)
            found += [attribute("content"), attribute("datetime"), attribute("href"), attribute("src"), _filled(decode_entities(text))]
        return F.coalesce(*found)

    card = lambda p: F.struct(field(p, TITLE).alias("title"), field(p, DATE).alias("date"), field(p, PLACE).alias("location"), field(p, DESCRIPTION).alias("description"), field(p, LINK).alias("detail_url"), field(p, IMAGE).alias("image_url"))
    return F.filter(F.transform(items, card), lambda c: c["title"].isNotNull())


def feed(page: Column) -> Column:
    """Cards of RSS items, or of Atom entries where no item has a title."""
    is_feed = page.rlike(r"(?i)<(rss|feed|rdf:RDF)\b")

    def cards(tag: str) -> Column:
        def card(block: Column) -> Column:
            def pick(*names: str) -> Column:
                inner = [F.regexp_extract(block, rf"(?is)<{n}\b[^>]*>(.*?)</{n}>", 1) for n in names]
                return F.coalesce(*[_filled(decode_entities(F.regexp_replace(x, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))) for x in inner])

            target = pick("link") if tag == "item" else _filled(F.regexp_extract(block, r"""(?s)<link[^>]*href=["']([^"']+)""", 1))
            fields = {"title": pick("title"), "date": pick("pubDate", "dc:date", "published", "updated"), "location": pick("location"), "description": pick("description", "summary", "content"), "detail_url": target, "image_url": F.lit(None).cast("string")}
            return F.struct(*[value.alias(name) for name, value in fields.items()])

        blocks = F.regexp_extract_all(page, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
        return F.filter(F.transform(blocks, card), lambda c: c["title"].isNotNull())

    return F.when(is_feed, F.coalesce(F.get(F.filter(F.array(cards("item"), cards("entry")), lambda c: F.size(c) > 0), F.lit(0)), F.array().cast(f"array<{CARD}>"))).otherwise(F.array().cast(f"array<{CARD}>"))
