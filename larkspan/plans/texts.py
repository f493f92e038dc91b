"""Queries of text functions, classification and page reading, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import classify, dates, geo, text
from larkspan.plans import views as V
from larkspan.session import table
from larkspan.sources import html

TODAY = "2026-01-17"


def language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = classify.language_profile(F.col("text"))
    rounded = F.transform(F.array(p), lambda x: F.struct(x["language"].alias("language"), F.round(x["dutch_score"], 6).alias("dutch_score"), F.round(x["english_score"], 6).alias("english_score")))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(rounded))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_PAIRS = " + ".join(f"CASE WHEN len(regexp_extract_all(t, '{p}')) > 2 THEN least(len(regexp_extract_all(t, '{p}')), 5) ELSE 0 END" for p in classify.DUTCH_PAIRS)
_MARKS = " + ".join(f"CASE WHEN contains(t, '{m}') THEN 10 ELSE 0 END" for m in classify.ENGLISH_MARKS)
_ENDS = "|".join("..." + ".*" + e for e in classify.DUTCH_ENDINGS)
LANGUAGE = f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, [w FOR w IN string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9_]+', ' ', 'g'), ' ') IF regexp_full_match(w, '[a-z]{{2,}}')] AS w FROM documents),
p AS (SELECT doc_id, length(t) >= 50 AND len(w) >= 10 AS enough,
  2 * len([x FOR x IN w IF list_contains({_list(classify.DUTCH_WORDS)}, x)]) + {_PAIRS} + len([x FOR x IN w IF regexp_full_match(x, '({_ENDS})')])
    + CASE WHEN len(regexp_extract_all(t, 'ij')) >= 2 THEN 2 * len(regexp_extract_all(t, 'ij')) ELSE 0 END AS nl,
  2 * len([x FOR x IN w IF list_contains({_list(classify.ENGLISH_WORDS)}, x)]) + {_MARKS} AS en FROM d),
s AS (SELECT doc_id, enough, CASE WHEN enough THEN nl / (nl + en + 1)::DOUBLE ELSE 0 END AS n, CASE WHEN enough THEN en / (nl + en + 1)::DOUBLE ELSE 0 END AS e FROM p)
SELECT doc_id, CASE WHEN NOT enough THEN 'Other' WHEN n > 0.6 AND e < 0.2 THEN 'NL' WHEN e > 0.6 AND n < 0.2 THEN 'EN' WHEN n > 0.3 AND e > 0.3 THEN 'Mixed' WHEN n > e THEN 'NL' WHEN e > n THEN 'EN' ELSE 'Other' END AS language,
  round(n, 6) AS dutch_score, round(e, 6) AS english_score FROM s"""


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    mode = classify.interaction_mode(F.lit(""), F.col("text"))
    return d.select("doc_id", classify.category(F.col("text"), F.concat(F.lit("https://x.example/"), F.when(F.col("doc_id") % 50 == 0, "museum/1").otherwise("a"))).alias("category"), mode.alias("mode"), F.when(F.col("text").isNotNull(), classify.is_probable_event(F.col("text"))).alias("probable"))


_CASES = " ".join(f"WHEN regexp_matches(u, '(?i){parts}') THEN '{name}'" for name, _, parts in classify.CATEGORY_WORDS)
_WORDS = " ".join(f"WHEN regexp_matches(t, '(?:^|[^A-Za-z0-9_])(?:{words})(?:$|[^A-Za-z0-9_])') THEN '{name}'" for name, words, _ in classify.CATEGORY_WORDS)
_MODES = " ".join(f"WHEN regexp_matches(' ' || t, '{pattern}') THEN '{mode}'" for mode, pattern in classify.INTERACTION)
CATEGORIES = f"""WITH d AS (SELECT doc_id, lower(text) AS t, 'https://x.example/' || CASE WHEN doc_id % 50 = 0 THEN 'museum/1' ELSE 'a' END AS u, lower(text) AS h FROM documents)
SELECT doc_id, CASE {_CASES} {_WORDS} ELSE 'COMMUNITY' END AS category, CASE {_MODES} ELSE 'high' END AS mode,
  NOT regexp_matches(h, '{classify.NOISE}') AND length(h) >= 5 AND h NOT IN ('admin', 'geen titel', 'no title', 'anonymous') AS probable FROM d"""


def persona_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir)
    return e.select("event_id", F.array_join(classify.persona_tags(F.col("title"), F.col("description"), F.when(F.col("event_id") % 3 == 0, "EN").otherwise("NL"), F.when(F.col("event_id") % 4 == 0, "passive").otherwise("medium")), ",").alias("tags"))


PERSONA = f"""WITH {V.EVENTS}, t AS (SELECT event_id, lower(title || ' ' || description) AS t FROM ev)
SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 3 = 0 THEN 'ExpatFriendly' END, CASE WHEN regexp_matches(t, 'brunch|morning|ochtend') THEN 'EarlyBird' END,
  CASE WHEN regexp_matches(t, 'night|avond|nacht|late|laat') THEN 'NightOwl' END, CASE WHEN regexp_matches(t, 'food|eten|culinair|diner|lunch|proeverij') THEN 'Foodie' END,
  CASE WHEN regexp_matches(t, 'kid|child|kind|familie|family|gezin') THEN 'FamilyFriendly' END, CASE WHEN regexp_matches(t, 'romantic|date|valentijn|couples|koppel') THEN 'DateNight' END,
  CASE WHEN regexp_matches(t, 'learn|leer|discover|ontdek|education|educatie') THEN 'Curious' END, CASE WHEN event_id % 4 = 0 THEN 'CultureVulture' END], lambda x: x IS NOT NULL), ',') AS tags FROM t"""


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir)
    day = F.date_format("event_date", "yyyy-MM-dd")
    return e.select(
        "event_id", text.normal_title(F.col("title")).alias("normal"), text.fingerprint(F.col("title"), day, F.col("venue_name")).alias("fingerprint"), text.content_hash(F.col("title"), day).alias("content"),
        text.address_key(F.col("venue_name"), F.lit(None).cast("string"), F.lit("1012 AB"), F.lit("Amsterdam "), F.lit(None).cast("string")).alias("address"),
        F.round(text.similarity(text.normal_title(F.col("title")), F.lit("weekly jazz night 12")), 6).alias("similar"), text.team_name(F.concat(F.lit("ajax "), F.col("category"), F.lit(" FC"))).alias("team"),
        F.coalesce(dates.daypart_label(F.col("event_time")), F.lit("")).alias("daypart"), geo.valid_coordinates(F.col("lat"), F.col("lng")).alias("valid"),
    )


_N = "trim(regexp_replace(regexp_replace(lower(title), '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
TEXT_KEYS = f"""WITH {V.EVENTS}, x AS (SELECT *, {_N} AS n, strftime(make_timestamp(ats * 1000000), '%Y-%m-%d') AS day FROM ev)
SELECT event_id, n AS normal, sha256(title || '|' || day || '|' || venue_name) AS fingerprint, sha256(title || '|' || day) AS content, lower(trim(venue_name || '||1012 AB|Amsterdam |NL')) AS address,
  round(CASE WHEN n = 'weekly jazz night 12' THEN 1.0 ELSE (greatest(length(n), 20) - levenshtein(n, 'weekly jazz night 12')) / greatest(length(n), 20)::DOUBLE END, 6) AS similar,
  'Ajax ' || upper(category[1]) || category[2:] AS team,
  CASE WHEN event_time IS NULL OR event_time = 'TBD' THEN '' WHEN substr(event_time, 1, 2)::INT BETWEEN 5 AND 11 THEN 'morning' WHEN substr(event_time, 1, 2)::INT BETWEEN 12 AND 16 THEN 'afternoon' ELSE 'evening' END AS daypart, true AS valid FROM x"""


def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, times, durations and prices in several notations, made from order keys and read again."""
    k = F.col("o_orderkey")
    day, month, year = k % 28 + 1, k % 12 + 1, k % 11 + 2020
    names = F.array(*[F.lit(m) for m in ("januari", "feb", "maart", "apr", "mei", "jun", "juli", "aug", "sept", "okt", "november", "dec")])
    written = F.when(k % 4 == 0, F.format_string("%04d-%02d-%02d", year, month, day)).when(k % 4 == 1, F.format_string("%d/%d/%d", day, month, year)).when(k % 4 == 2, F.concat_ws(" ", F.lit("za"), day.cast("string"), F.element_at(names, month.cast("int")), year.cast("string"))).otherwise("morgen")
    time = F.when(k % 3 == 0, F.format_string("aanvang: %d:%02d", k % 24, k % 60)).when(k % 3 == 1, F.format_string("%d.%02d pm", k % 11 + 1, k % 60)).otherwise(F.format_string("%d uur", k % 24))
    length = F.format_string("%dh %dmin", k % 5, k % 60)
    price = F.format_string("van %d,50 tot %d euro", k % 50, k % 130)
    today = F.lit(TODAY).cast("date")
    return table(spark, sf_dir, "orders").select(k.alias("order_id"), dates.iso_date(written, today).alias("iso"), dates.rolling_date(written, today).alias("rolled"), dates.clock_time(time).alias("clock"), dates.minutes_of(length).alias("minutes"), classify.price_range(price).alias("price"))


PARSED = """WITH k AS (SELECT o_orderkey AS k, o_orderkey % 28 + 1 AS d, o_orderkey % 12 + 1 AS m, o_orderkey % 11 + 2020 AS y FROM orders)
SELECT k AS order_id, CASE WHEN k % 4 = 3 THEN '2026-01-18' ELSE printf('%04d-%02d-%02d', y, m, d) END AS iso, CASE WHEN k % 4 = 3 THEN '2026-01-18' ELSE printf('%04d-%02d-%02d', y, m, d) END AS rolled,
  CASE k % 3 WHEN 0 THEN printf('%02d:%02d', k % 24, k % 60) WHEN 1 THEN printf('%02d:%02d', k % 11 + 13, k % 60) ELSE printf('%02d:00', k % 24) END AS clock, nullif(k % 5 * 60 + k % 60, 0)::INT AS minutes,
  CASE WHEN greatest(k % 50 + 0.5, k % 130) <= 15 THEN '€' WHEN greatest(k % 50 + 0.5, k % 130) <= 40 THEN '€€' WHEN greatest(k % 50 + 0.5, k % 130) <= 100 THEN '€€€' ELSE '€€€€' END AS price FROM k"""


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir)
    k = F.col("event_id")
    errors = classify.validation_errors(F.when(k % 10 == 0, "AB").otherwise(F.col("title")), F.col("category"), F.when(k % 6 != 0, F.concat(F.lit("https://x.example/"), k.cast("string"))).otherwise(F.when(k % 12 == 0, "ftp:/x")), F.when(k % 15 != 0, "Amsterdam"))
    return e.select("event_id", F.array_join(errors, "; ").alias("errors"), (F.size(errors) == 0).alias("is_valid"))


VALIDATED = f"""WITH {V.EVENTS}, x AS (SELECT event_id AS k, category FROM ev),
e AS (SELECT k, list_filter([CASE WHEN k % 6 = 0 AND k % 12 <> 0 THEN 'Missing required field: source_url' END, CASE WHEN k % 10 = 0 THEN 'Title too short (min 3 characters)' END,
  CASE WHEN k % 15 = 0 THEN 'City is required' END, CASE WHEN k % 12 = 0 THEN 'Invalid source_url' END], lambda x: x IS NOT NULL) AS l FROM x)
SELECT k AS event_id, array_to_string(l, '; ') AS errors, len(l) = 0 AS is_valid FROM e"""


def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/?utm_source=a&id="), F.col("page_id").cast("string"), F.lit("&fbclid=b#top"))
    return table(spark, sf_dir, "pages").select("page_id", text.domain(F.col("url")).alias("domain"), text.canonical_url(text.without_tracking(u)).alias("canonical"), text.resolve_url(F.lit("/a/b"), F.col("url")).alias("resolved"))


URL_KEYS = r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)), '^www\.', '') AS domain,
  regexp_replace(url, '[?#].*$', '') || '/?id=' || page_id::VARCHAR AS canonical, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || '/a/b' AS resolved FROM pages"""


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    f = html.framework(F.col("html"))
    return p.select("page_id", html.page_facts(F.col("html")).alias("f"), f.alias("c"), F.length(text.to_markdown(F.col("html"))).alias("markdown_chars"), F.coalesce(html.best_image(F.col("html")), F.lit("")).alias("image")).select("page_id", "f.title", "f.heading", "f.words", "c.cms", "c.confidence", "markdown_chars", "image")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links(table(spark, sf_dir, "pages"), "page_id", "url", "html", allowed=r"(?i)/")


_DECODED = "href"
for _name, _sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&euro;", "€"), ("&amp;", "&")):
    _DECODED = f"replace({_DECODED}, '{_name}', '{_sign}')"
#: The pages' links are paths from the root.
LINKS = rf"""WITH l AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) AS origin, regexp_extract_all(html, '(?i)href=["'']([^"''#]+)["'']', 1) AS l FROM pages),
h AS (SELECT page_id, origin, unnest(l) AS href, unnest(range(len(l))) AS at_ FROM l), x AS (SELECT page_id, at_, regexp_replace(origin || {_DECODED}, '/+$', '') AS link FROM h),
f AS (SELECT page_id, link, min(at_) AS at_ FROM x WHERE NOT regexp_matches(link, '(?i)\.(jpg|jpeg|png|gif|svg|css|js|pdf|zip|ico|webp)(\?|$)') GROUP BY 1, 2),
r AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY at_, link)::INT AS rank FROM f) SELECT page_id, rank, link FROM r WHERE rank <= 50"""


def extracted_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with event data added in five notations by page number, read by the waterfall."""
    k = F.col("page_id")
    title = F.concat(F.lit("Event "), k.cast("string"))
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type":"MusicEvent","name":"'), title, F.lit('","startDate":"2026-05-01","location":{"name":"Hall"}}</script>'))
    state = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"events":[{"title":"'), title, F.lit('","date":"2026-05-02"}]}}</script>'))
    micro = F.concat(F.lit('<div itemscope itemtype="https://schema.org/Event"><span itemprop="name">'), title, F.lit('</span><meta itemprop="startDate" content="2026-05-03"></div>'))
    dom = F.concat(F.lit('<li class="event-card"><h3>'), title, F.lit('</h3><time datetime="2026-05-04">4 May</time></li>'))
    added = F.when(k % 5 == 0, ld).when(k % 5 == 1, state).when(k % 5 == 2, micro).when(k % 5 == 3, dom).otherwise("")
    read = html.waterfall(table(spark, sf_dir, "pages").select("page_id", F.concat("html", added).alias("html")), "page_id", "html")
    card = F.get("cards", F.lit(0))
    return read.select("page_id", "strategy", card["title"].alias("title"), card["date"].alias("date"), F.size("cards").alias("cards"))


CARDS = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'json_ld' WHEN 1 THEN 'hydration' WHEN 2 THEN 'microdata' WHEN 3 THEN 'dom' END AS strategy,
  CASE WHEN page_id % 5 < 4 THEN 'Event ' || page_id::VARCHAR END AS title, CASE page_id % 5 WHEN 0 THEN '2026-05-01' WHEN 1 THEN '2026-05-02' WHEN 2 THEN '2026-05-03' WHEN 3 THEN '2026-05-04' END AS date,
  CASE WHEN page_id % 5 < 4 THEN 1 ELSE 0 END AS cards FROM pages"""


def calendar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as iCalendar texts and read again."""
    e = V.events(spark, sf_dir)
    written = e.select("event_id", html.calendar_text(F.col("event_id").cast("string"), F.col("title"), F.col("event_date"), F.timestamp_seconds(F.unix_seconds("event_date") + 7200), F.col("venue_name"), F.col("description")).alias("ics"))
    return html.calendar_events(written, "event_id", "ics").select("event_id", "ordinal", "summary", "start", "end", "location")


CALENDAR = f"""WITH {V.EVENTS} SELECT event_id, 0 AS ordinal, title AS summary, strftime(make_timestamp(ats * 1000000), '%Y%m%dT%H%M%SZ') AS start, strftime(make_timestamp((ats + 7200) * 1000000), '%Y%m%dT%H%M%SZ') AS "end", venue_name AS location FROM ev"""


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = table(spark, sf_dir, "nation").select(F.initcap("n_name").alias("city"))
    return html.search_queries(cities, ["{city} agenda", "events in {city}", "uitagenda {city} {city}"]).select("city", "query")


SEARCH = """WITH c AS (SELECT upper(n_name[1]) || lower(n_name[2:]) AS city FROM nation) SELECT city, replace(t, '{city}', city) AS query FROM c, (SELECT unnest(['{city} agenda', 'events in {city}', 'uitagenda {city} {city}']) AS t)"""

QUERIES = {
    "c4_language_profiles": (language_profiles, LANGUAGE), "c1_categories": (categories, CATEGORIES), "c6_persona_tags": (persona_tags, PERSONA), "x1_text_keys": (text_keys, TEXT_KEYS),
    "d1_parsed_dates": (parsed_dates, PARSED), "c8_validated": (validated, VALIDATED), "x12_url_keys": (url_keys, URL_KEYS), "s12_page_facts": (page_facts, None), "s22_page_links": (page_links, LINKS),
    "s11_extracted_cards": (extracted_cards, CARDS), "s18_calendar_round_trip": (calendar_round_trip, CALENDAR), "s21_search_queries": (search_queries, SEARCH),
}
