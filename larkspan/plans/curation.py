"""Queries of the curation rules over events and pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import classify, curation, dates, labels, text
from larkspan.plans import views as V
from larkspan.plans.samples import dealt, dealt_sql, joined, quoted
from larkspan.session import table

_WORDS = ["workshop koken", "Borrel met wijn", "netwerken", "KINDEREN", "straat", "gemeenteraad", "De Markt", "live muziek", "hardlopen", "sinterklaas", "singles night", "een avond", "tabletop", "bos en duinen", "samen", ""]
_NAMES = ["Jazz Night", "ab", "", None, "Agenda", "Concerten in Zwolle", "  x ", "Visit Utrecht", "Rondleiding", "Open Stage", "Tones", "Tones of Jazz"]
_URLS = ["https://a.example/agenda/x/jazz-night", "https://a.example/tickets/jazz", "https://a.example/e/1", "https://a.example/archive/events/77/", "https://a.example/x/y/12-05-2026", "https://a.example/serie/x/y", "https://www.eventbrite.com/b/netherlands/x", "https://a.example/events/", "https://a.example/nl/agenda", "https://ra.co/x", None, "", "https://vvv.example/a", "https://songkick.example/metro-areas/3", "http://a.example", "https://m.facebook.com/e", "ftp:/x"]
_IMAGES = ["https://a.example/x.JPG", "https://cdn.example/logo.png", None, "", "https://cdn.example/x", "https://a.example/images/1", "https://a.example/pixel/x.gif", "https://a.example/x", "https://a.cloudfront.net/q"]
_STARTS = ["1998-05-01", "1999-01-01T20:00:00", None, "", "soon", "2001-02-03", "1998-13-40"]
_CITIES = ["Amsterdam", None, "Zwolle", ""]
_TICKETS = ["https://t.example/1", None, "tickets", "http://t.example"]


def substring_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir).select("event_id", F.concat(F.lit("x "), dealt("event_id", _WORDS), F.lit(" "), "title").alias("t"))
    return e.select("event_id", curation.category_by_parts(F.col("t")).alias("category"))


_RULES = " ".join(f"WHEN regexp_matches(t, {quoted(parts)}) THEN '{name}'" for name, parts in curation.PARTS)
CATEGORY_CASE = f"""CASE WHEN regexp_matches(t, {quoted(curation.FAMILY_FIRST)}) THEN 'FAMILY'
  WHEN regexp_matches(t, {quoted(curation.SOCIAL_FIRST)}) THEN CASE WHEN regexp_matches(t, {quoted(curation.SOCIAL_FOOD)}) THEN 'FOOD' ELSE 'SOCIAL' END {_RULES} ELSE 'COMMUNITY' END"""
SUBSTRING = f"""WITH {V.EVENTS}, d AS (SELECT event_id, lower('x ' || {dealt_sql('event_id', _WORDS)} || ' ' || title) AS t FROM ev)
SELECT event_id, {CATEGORY_CASE} AS category FROM d"""


def quick_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    name, url, start = dealt("k", _NAMES), dealt("k", _URLS, 3), dealt("k", _STARTS, 5)
    return e.select(
        F.col("k").alias("event_id"), curation.quick_error(name, url, dealt("k", ["music", None, "food"], 7)).alias("quick"),
        curation.strategy_error(name, dealt("k", _CITIES, 7), start, dealt("k", _TICKETS, 11)).alias("strategy"),
    )


QUICK = f"""WITH d AS (SELECT o_orderkey AS k, {dealt_sql('o_orderkey', _NAMES)} AS n, {dealt_sql('o_orderkey', _URLS, 3)} AS u, {dealt_sql('o_orderkey', ['music', None, 'food'], 7)} AS c,
  {dealt_sql('o_orderkey', _CITIES, 7)} AS city, {dealt_sql('o_orderkey', _STARTS, 5)} AS s, {dealt_sql('o_orderkey', _TICKETS, 11)} AS t FROM orders)
SELECT k AS event_id, CASE WHEN length(coalesce(n, '')) < 3 THEN 'Missing or invalid name' WHEN coalesce(u, '') = '' THEN 'Missing source_url' WHEN c IS NULL THEN 'Missing category' END AS quick,
  CASE WHEN length(trim(coalesce(n, ''))) < 3 THEN 'Event name is required and must be at least 3 characters' WHEN coalesce(city, '') = '' THEN 'City is required'
    WHEN s IN ('soon', '1998-13-40') THEN 'Invalid start_time format (expected ISO 8601)' WHEN t = 'tickets' THEN 'Invalid ticket_url format' END AS strategy FROM d"""

_CATEGORIES = ["MUSIC", "Outdoors", None, "", "Comedy", "wellness", "outdoor", "Arts", "club", "Fitness", "party", "theatre"]
_WRITTEN = ["1998-05-01", "1998-05-01T00:00:00", "1998-05-01T20:30:00", "1998-05-02"]
_ENDS = [None, "1998-05-01T23:00:00", "1998-05-02T01:00:00"]


def persisted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    c, start, end = dealt("k", _CATEGORIES), dealt("k", _WRITTEN, 2), dealt("k", _ENDS, 3)
    return e.select(
        F.col("k").alias("event_id"), curation.stored_category(c).alias("stored"), curation.older_category(c).alias("older"), curation.migrated_category(c).alias("migrated"),
        labels.is_all_day(F.col("k") % 10 == 0, start).alias("all_day"), labels.is_multi_day(F.lit(None).cast("boolean"), start.cast("timestamp"), end.cast("timestamp")).alias("multi_day"),
        labels.is_bare_midnight(start.cast("timestamp"), c).alias("bare_midnight"),
    )


_OLD = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in curation.OLDER.items())
_MIGRATED = " ".join(f"WHEN lower(c) IN ({', '.join(map(quoted, keys))}) THEN '{name}'" for name, keys in curation.MIGRATED)
PERSISTED = f"""WITH d AS (SELECT o_orderkey AS k, {dealt_sql('o_orderkey', _CATEGORIES)} AS c, {dealt_sql('o_orderkey', _WRITTEN, 2)} AS s, {dealt_sql('o_orderkey', _ENDS, 3)} AS e FROM orders)
SELECT k AS event_id, CASE WHEN coalesce(c, '') = '' THEN 'community' WHEN lower(c) = 'outdoors' THEN 'outdoor' ELSE lower(c) END AS stored, CASE lower(c) {_OLD} ELSE 'COMMUNITY' END AS older,
  CASE {_MIGRATED} ELSE 'COMMUNITY' END AS migrated, k % 10 = 0 OR NOT contains(s, 'T') AS all_day, coalesce(s::TIMESTAMP::DATE <> e::TIMESTAMP::DATE, false) AS multi_day,
  strftime(s::TIMESTAMP, '%H:%M') = '00:00' AND coalesce(lower(c), '') NOT IN ('music', 'nightlife', 'entertainment') AS bare_midnight FROM d"""

_DATES = ["2026-01-05", "12 maart 2026", "3 mei\n2026", "2025-12-31", "", None, "vr 6 juni 2026", "morgen"]


def cheap_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards as rows of events; those without a title or a date in 2026 go."""
    today = F.lit("2026-01-17").cast("date")
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    title, hint = dealt("k", ["Jazz  Night", None, " Book\tTable "], 2), dealt("k", [None, "concert", "borrel"], 5)
    date = dates.iso_date(text.collapse(dealt("k", _DATES)), today)
    time = F.coalesce(dealt("k", [None, "21:00"], 7), dates.clock_time(dealt("k", ["aanvang: 20:30", None], 3)), F.lit("TBD"))
    rows = e.select(F.col("k").alias("event_id"), text.collapse(title).alias("title"), date.alias("event_date"), time.alias("event_time"), F.coalesce(dealt("k", ["Hall", None], 3), F.lit("Source")).alias("venue_name"), curation.category_by_parts(F.coalesce(hint, title)).alias("category"))
    return rows.filter(F.col("title").isNotNull() & F.col("event_date").startswith("2026-"))


CHEAP = f"""WITH d AS (SELECT o_orderkey AS k, {dealt_sql('o_orderkey', ['Jazz Night', None, 'Book Table'], 2)} AS title,
  {dealt_sql('o_orderkey', ['2026-01-05', '2026-03-12', '2026-05-03', '2025-12-31', None, None, '2026-06-06', '2026-01-18'])} AS event_date,
  coalesce({dealt_sql('o_orderkey', [None, '21:00'], 7)}, {dealt_sql('o_orderkey', ['20:30', None], 3)}, 'TBD') AS event_time, coalesce({dealt_sql('o_orderkey', ['Hall', None], 3)}, 'Source') AS venue_name,
  {dealt_sql('o_orderkey', [None, 'concert', 'borrel'], 5)} AS hint FROM orders),
x AS (SELECT *, lower(coalesce(hint, title)) AS t FROM d WHERE title IS NOT NULL AND event_date LIKE '2026-%')
SELECT k AS event_id, title, event_date, event_time, venue_name, {CATEGORY_CASE} AS category FROM x"""


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    name, url, start, image = dealt("k", _NAMES), dealt("k", _URLS, 3), dealt("k", _STARTS, 5), dealt("k", _IMAGES)
    errors = curation.curated_errors(F.col("k") % 13 != 0, url, name, dealt("k", _CITIES, 7), start)
    about = F.substring(F.lit("something to do together"), 1, (F.col("k") % 26).cast("int"))
    warnings = curation.curated_warnings(start, about, image, dealt("k", [0.25, 0.5, 0.0], 2), dealt("k", [0.75, 0.25], 3), V.now())
    return e.select(F.col("k").alias("event_id"), F.array_join(errors, "; ").alias("errors"), F.array_join(warnings, "; ").alias("warnings"), (F.size(errors) == 0).alias("is_valid"), curation.is_event_image(image).alias("image_ok"))


CURATED = f"""WITH d AS (SELECT o_orderkey AS k, {dealt_sql('o_orderkey', _NAMES)} AS n, {dealt_sql('o_orderkey', _URLS, 3)} AS u, {dealt_sql('o_orderkey', _CITIES, 7)} AS city,
  coalesce({dealt_sql('o_orderkey', _STARTS, 5)}, '') AS s, {dealt_sql('o_orderkey', _IMAGES)} AS img, least(o_orderkey % 26, 24) AS len, {dealt_sql('o_orderkey', [0.25, 0.5, 0.0], 2)}::DOUBLE AS conf, {dealt_sql('o_orderkey', [0.75, 0.25], 3)}::DOUBLE AS comp FROM orders),
p AS (SELECT *, coalesce(nullif(lower(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1)), ''), '/') AS path, NOT ({' OR '.join(f"contains(lower(coalesce(img, '')), {quoted(x)})" for x in curation.NO_IMAGE)}) AND coalesce(regexp_matches(img, {quoted(curation.IMAGE)}), false) AS image_ok FROM d),
e AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'No data extracted' WHEN u LIKE '%://%' AND (regexp_matches(path, {quoted(curation.LISTING_PATH)}) OR regexp_matches(path, {quoted(curation.OTHER_PATH)}) OR regexp_matches(path, '/0*[0-9]{{1,4}}/?$')
    OR (len(list_filter(string_split(path, '/'), lambda x: x <> '')) <= 2 AND NOT contains(path, '-20') AND (NOT regexp_matches(path, {quoted(curation.EVENT_PATH)}) OR len(list_filter(string_split(path, '/'), lambda x: x <> '')) < 2))) THEN 'Extracted from listing page, not event detail'
  ELSE {joined(["CASE WHEN coalesce(n, '') = '' THEN 'Missing event title' END", f"CASE WHEN regexp_matches(n, {quoted(curation.GENERIC_TITLE)}) THEN 'Generic/non-event page title detected' END", "CASE WHEN coalesce(city, '') = '' THEN 'Missing city' END", "CASE WHEN s IN ('soon', '1998-13-40') THEN 'Invalid start datetime' END"])} END AS errors FROM p)
SELECT k AS event_id, errors, {joined(["CASE WHEN s = '' THEN 'No start datetime' WHEN s = '1998-05-01' THEN 'Event is in the past' END", "CASE WHEN len < 20 THEN 'Short description (' || len || ' chars)' END", "CASE WHEN len = 0 THEN 'Empty description' END", "CASE WHEN NOT image_ok THEN 'Invalid or missing event image' END", "CASE WHEN conf = 0.25 THEN 'Low extraction confidence: 0.25' END", "CASE WHEN comp = 0.25 THEN 'Low data completeness: 0.25' END"])} AS warnings,
  errors = '' AS is_valid, image_ok FROM e"""

_BLOCKS = ["<div class='event-card big'>a</div><div class=\"card\">x</div>", "<li class=\"card item\">y</li>", "<p class=\"css-1x sc-2\">z</p>", "<div class='cardinal'>q</div>"]


def healed_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often classes occur in pages with blocks added by number, and the confidence in selectors built on them."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.col("html"), F.repeat(dealt("page_id", _BLOCKS), (F.col("page_id") % 5).cast("int"))).alias("h"))
    cards, items = curation.class_matches(F.col("h"), "card"), curation.class_matches(F.col("h"), "event-card")
    p = p.select("page_id", cards.alias("cards"), items.alias("items"), F.array_contains(curation.repeated_classes(F.col("h")), "card").alias("repeats"))
    confidence = curation.healing_confidence(F.col("cards"), F.col("page_id") % 4, (F.col("cards") > 0).cast("int") + (F.col("items") > 0).cast("int"))
    return p.select("page_id", "cards", "items", "repeats", F.round(confidence, 6).alias("confidence"))


HEALED = f"""WITH d AS (SELECT page_id, html || repeat({dealt_sql('page_id', _BLOCKS)}, (page_id % 5)::INT) AS h FROM pages),
c AS (SELECT page_id, len(regexp_extract_all(h, {quoted('''(?i)class=["'][^"']*\\bcard\\b[^"']*["']''')}))::INT AS cards, len(regexp_extract_all(h, {quoted('''(?i)class=["'][^"']*\\bevent-card\\b[^"']*["']''')}))::INT AS items,
  len(list_filter(string_split(regexp_replace(array_to_string(regexp_extract_all(h, {quoted('''(?i)class=["']([^"']+)["']''')}, 1), ' '), '\\s+', ' ', 'g'), ' '), lambda x: x = 'card')) BETWEEN 3 AND 50 AS repeats FROM d)
SELECT *, round(least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN cards > 0 THEN 0.2::DOUBLE + CASE WHEN page_id % 4 > 0 THEN least(cards, page_id % 4) / greatest(cards, page_id % 4)::DOUBLE * 0.15::DOUBLE ELSE 0 END ELSE 0 END
  + ((cards > 0)::INT + (items > 0)::INT) / 3.0::DOUBLE * 0.15::DOUBLE), 6) AS confidence FROM c"""

_PAGE_TIMES = ["<p>20:15 uur</p>", "<p>aanvang: 9.30</p>", "<p>Doors 7:05</p>", ""]
_PAGE_HEADS = ['<meta property="og:title" content="Og night">', "<title>Own title | Site</title>", "<h1 class='a'> Heading </h1>", ""]
_PAGE_VENUES = ['<script>{"location": {"@type":"Place","name": "Hall"}}</script>', "<b class='x venue-name'> Cafe </b>", ""]
_HINTS = ["12 maart 2026", "2026-04-01", "binnenkort", None, "op 3 MEI 2026"]


def rule_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read from snippets before pages by rules alone; those without a date go."""
    k = F.col("page_id")
    h = F.concat(dealt("page_id", _PAGE_HEADS), dealt("page_id", _PAGE_TIMES, 2), dealt("page_id", _PAGE_VENUES, 3), dealt("page_id", ["<meta name='description' content='About music'>", ""], 5), F.lit("<p>end</p>"))
    p = table(spark, sf_dir, "pages").select("page_id", h.alias("h"), curation.loose_date(dealt("page_id", _HINTS)).alias("event_date"), F.when(k % 7 == 0, "Hinted").alias("hint"))
    title = F.coalesce("hint", curation.page_title(F.col("h")), F.lit("Unknown Event"))
    mode = classify.interaction_mode(F.lit("CULTURE"), F.coalesce(curation.page_description(F.col("h")), F.lit("")))
    rows = p.select("page_id", title.alias("title"), F.substring(curation.page_description(F.col("h")), 1, 500).alias("description"), "event_date", F.coalesce(curation.page_time(F.col("h")), F.lit("20:00")).alias("start_time"), F.coalesce(curation.page_venue(F.col("h")), F.lit("TBD")).alias("venue_name"), F.lit("CULTURE").alias("category"), mode.alias("interaction_mode"))
    return rows.filter(F.col("event_date").isNotNull())


RULE_ENRICHED = f"""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'Hinted' ELSE {dealt_sql('page_id', ['Og night', 'Own title', 'Heading', 'Unknown Event'])} END AS title, {dealt_sql('page_id', ['About music', None], 5)} AS description,
  {dealt_sql('page_id', ['2026-03-12', '2026-04-01', None, None, '2026-05-03'])} AS event_date, {dealt_sql('page_id', ['20:15', '09:30', '07:05', '20:00'], 2)} AS start_time, {dealt_sql('page_id', ['Hall', 'Cafe', 'TBD'], 3)} AS venue_name, 'CULTURE' AS category, 'passive' AS interaction_mode
FROM pages WHERE page_id % 5 NOT IN (2, 3)"""

_SHOWN = ["", '<div id="root"></div>', "Checking your browser", "__NEXT_DATA__", '<link type="application/rss+xml">', "<p>loading=\"lazy\" wp-content</p>", "recaptcha"]


def fetch_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, dealt("page_id", _URLS, 3)).otherwise(F.col("url")).alias("u"), F.when(F.col("page_id") % 31 != 0, F.concat("html", dealt("page_id", _SHOWN))).alias("h"))
    return p.select("page_id", curation.fetch_strategy(F.coalesce("u", F.lit("")), F.col("h")).alias("s")).select("page_id", "s.*")


_GUARD = f"regexp_matches(h, {quoted(curation.GUARDED)})"
_SCRIPT = f"regexp_matches(h, {quoted(curation.NEEDS_SCRIPT)})"


def _by_domain(place: int, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(u, {quoted(d[0])}) THEN {quoted(d[place])}" for d in curation.KNOWN_DOMAINS) + f" ELSE {otherwise} END"


STRATEGIES = f"""WITH d AS (SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN {dealt_sql('page_id', _URLS, 3)} ELSE url END, '') AS u, CASE WHEN page_id % 31 <> 0 THEN html || {dealt_sql('page_id', _SHOWN)} END AS h FROM pages)
SELECT page_id, {_by_domain(1, f"CASE WHEN h IS NULL THEN 'playwright' WHEN {_GUARD} THEN 'browserless' WHEN {_SCRIPT} THEN 'playwright' ELSE 'static' END")} AS fetcher, {_by_domain(2, 'NULL')} AS wait_for,
  {_by_domain(3, f'coalesce({_GUARD}, false)')} AS anti_bot, CASE WHEN {' OR '.join(f'contains(u, {quoted(d[0])})' for d in curation.KNOWN_DOMAINS)} THEN 30000 ELSE 15000 END AS timeout_ms FROM d"""


def recommended_fetchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.concat("html", dealt("page_id", _SHOWN)).alias("h"))
    r = curation.recommended_fetcher(F.col("h"), F.col("page_id") % 6, (F.col("page_id") % 4) / 4.0, F.col("page_id") % 2)
    return p.select("page_id", r.alias("r")).select("page_id", "r.fetcher", F.round("r.confidence", 6).alias("confidence"))


def _score(fetcher: str) -> str:
    parts = [f"CASE WHEN regexp_matches(h, {quoted(p)}) THEN {w}::DOUBLE ELSE 0 END" for w, f, p in curation.SIGNALS if f == fetcher]
    if fetcher == "puppeteer":
        parts += ["CASE WHEN contains(h, 'id=\"app\"') AND contains(h, 'v-') THEN 0.9::DOUBLE ELSE 0 END", "CASE WHEN length(h) < 1000 OR (length(h) > 1000 AND length(t) < 200) THEN 0.5::DOUBLE ELSE 0 END"]
        parts += ["CASE WHEN page_id % 4 < 2 AND page_id % 2 > 0 THEN 0.4::DOUBLE ELSE 0 END", "CASE WHEN page_id % 6 >= 3 THEN 0.3::DOUBLE * (page_id % 6) ELSE 0 END"]
    if fetcher == "static":
        parts.append("CASE WHEN length(h) > 5000 AND len(regexp_extract_all(h, '<!--')) > 3 THEN 0.4::DOUBLE ELSE 0 END")
    return f"{curation.PRIOR[fetcher]}::DOUBLE + " + " + ".join(parts or ["0"])


RECOMMENDED = f"""WITH d AS (SELECT page_id, html || {dealt_sql('page_id', _SHOWN)} AS h FROM pages), x AS (SELECT *, trim(regexp_replace(regexp_replace(h, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS t FROM d),
s AS (SELECT page_id, {', '.join(f'round({_score(f)}, 9) AS {f}' for f in curation.PRIOR)} FROM x), m AS (SELECT *, greatest({', '.join(curation.PRIOR)}) AS top FROM s)
SELECT page_id, CASE {' '.join(f"WHEN {f} = top THEN '{f}'" for f in curation.PRIOR)} END AS fetcher, round(top / ({' + '.join(curation.PRIOR)}), 6) AS confidence FROM m"""

_TIMES = ["20:00", "8.30 pm", "half nine", None, "7:05", ""]
_LANGUAGES = ["NL", "EN", "Mixed", "Other"]


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    tags = F.when(F.col("k") % 3 == 0, F.array(F.lit("ExpatFriendly"))).when(F.col("k") % 3 == 1, F.array(F.lit("Foodie")))
    return e.select(
        F.col("k").alias("event_id"), curation.repaired_time(dealt("k", _TIMES)).alias("start_time"), curation.repaired_time(dealt("k", _TIMES, 2), F.lit(None).cast("string")).alias("doors_open"),
        curation.repaired_date(dealt("k", ["2026-01-01", "soon", None]), dealt("k", _HINTS, 3)).alias("event_date"), F.array_join(curation.repaired_tags(tags, dealt("k", _LANGUAGES, 2)), ",").alias("tags"),
    )


REPAIRED = f"""WITH d AS (SELECT o_orderkey AS k, {dealt_sql('o_orderkey', ['2026-01-01', 'soon', None])} AS date, {dealt_sql('o_orderkey', ['2026-03-12', '2026-04-01', None, None, '2026-05-03'], 3)} AS hint, {dealt_sql('o_orderkey', _LANGUAGES, 2)} IN ('EN', 'Mixed') AS en FROM orders)
SELECT k AS event_id, {dealt_sql('k', ['20:00', '08:30', 'half nine', None, '07:05', ''])} AS start_time, {dealt_sql('k', ['20:00', '08:30', None, None, '07:05', ''], 2)} AS doors_open, CASE WHEN date = 'soon' THEN coalesce(hint, date) ELSE date END AS event_date,
  CASE k % 3 WHEN 0 THEN 'ExpatFriendly' WHEN 1 THEN CASE WHEN en THEN 'Foodie,ExpatFriendly' ELSE 'Foodie' END ELSE CASE WHEN en THEN 'ExpatFriendly' ELSE '' END END AS tags FROM d"""

_MAPS = [
    '<script type="application/ld+json">{"@type":"Event","location":{"@type":"Place","geo":{"latitude":52.36,"longitude":"4.88"}}}</script>', '<i itemprop="latitude" content="51.5"></i><i itemprop="longitude">4.25</i>',
    '<meta property="place:location:latitude" content="53.2"><meta property="place:location:longitude" content="6.5">', '<a href="https://www.google.com/maps/place/x/@52.1,5.1,17z">m</a>', '<meta name="geo.position" content="50.8;5.7">',
    '<meta name="ICBM" content="52.5, 6.1">', '<meta property="og:latitude" content="0"><meta property="og:longitude" content="0">', "", '<a href="https://www.openstreetmap.org/x#map=15/52.7/6.2">o</a>',
    '<meta content="53.25" property="place:location:latitude"><meta content="6.75" property="place:location:longitude">', '<meta content="50.75, 5.5" name="ICBM">',
    '<script type="application/ld+json">[{"@type":"Product","geo":{"latitude":1,"longitude":2}},{"@type":"GeoCoordinates","lat":"52.25","lon":4.5}]</script>',
    '<script type="application/ld+json">{"@graph":[{"@type":"Place","geo":{"latitude":95,"longitude":4}},{"@type":"Place","geo":{"latitude":-51.75,"lng":4.75}}]}</script>',
    '<script type="application/ld+json">{"@type":"Product","geo":{"latitude":1,"longitude":2}}</script>', '<script type="application/ld+json">{broken "geo": {"latitude": 1, "longitude": 2}</script>',
]
_FOUND = [(52.36, 4.88, "jsonld", 0.95), (51.5, 4.25, "microdata", 0.9), (53.2, 6.5, "opengraph", 0.9), (52.1, 5.1, "embed", 0.85), (50.8, 5.7, "meta", 0.85), (52.5, 6.1, "meta", 0.8), (None,) * 4, (None,) * 4, (52.7, 6.2, "embed", 0.85),
          (53.25, 6.75, "opengraph", 0.9), (50.75, 5.5, "meta", 0.8), (52.25, 4.5, "jsonld", 0.9), (-51.75, 4.75, "jsonld", 0.9), (None,) * 4, (None,) * 4]


def page_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    filler = F.repeat(F.lit("<p>words of a page</p>"), 6)
    p = table(spark, sf_dir, "pages").select("page_id", curation.page_coordinates(F.when(F.col("page_id") % 20 == 19, "<p>short</p>").otherwise(F.concat(dealt("page_id", _MAPS), filler))).alias("c"))
    return p.select("page_id", "c.lat", "c.lng", "c.source", "c.confidence")


PLACES = "SELECT page_id, " + ", ".join(f"CASE WHEN page_id % 20 <> 19 THEN {dealt_sql('page_id', [f[i] for f in _FOUND])}{'::DOUBLE' if i != 2 else ''} END AS {name}" for i, name in enumerate(("lat", "lng", "source", "confidence"))) + " FROM pages"


def client_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose title, venue or category holds the query, in one category."""
    from larkspan.operators.feed import searched

    return searched(V.events(spark, sf_dir), "Venue 1", "Social").select("event_id", "title", "venue_name", "category")


CLIENT_SEARCH = f"WITH {V.EVENTS} SELECT event_id, title, venue_name, category FROM ev WHERE (contains(lower(title), 'venue 1') OR contains(lower(venue_name), 'venue 1') OR contains(lower(category), 'venue 1')) AND category = 'social'"

QUERIES = {
    "c2_substring_categories": (substring_categories, SUBSTRING), "c9_quick_checks": (quick_checks, QUICK), "c12_persisted_rows": (persisted_rows, PERSISTED), "c13_cheap_normalised": (cheap_normalised, CHEAP),
    "c14_curated": (curated, CURATED), "c15_healed_selectors": (healed_selectors, HEALED), "c16_rule_enriched": (rule_enriched, RULE_ENRICHED), "c17_fetch_strategies": (fetch_strategies, STRATEGIES),
    "s14_recommended_fetchers": (recommended_fetchers, RECOMMENDED), "c19_repaired": (repaired, REPAIRED), "g9_page_places": (page_places, PLACES), "f8_client_search": (client_search, CLIENT_SEARCH),
}
