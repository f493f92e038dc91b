"""Rules that every collected event meets: categories, validity, images, fetch strategies, repairs. Lists are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.text import any_part, first_match
from larkspan.sources import structured

#: Parts of a text that force a category before all others.
FAMILY_FIRST = "basisschool|speeltuin|kinderopvang|zwemles|peutergroep|kinderfeest|jeugdclub|schoolfeest|kinderactiviteit|gezinsdag|voorlezen|kinderboerderij|kinderdisco|sinterklaas|kinderen|ouder-kind"
SOCIAL_FIRST = "borrel|vrijdagmiddag|vrijmibo|netwerken|networking|proeverij|wijnproeverij|bierproeverij|happy hour|afterwork|stamppot|vrijgezellenfeest|singles|speed date"
SOCIAL_FOOD = "proeverij|wijn|bier|eten"
#: Fixed values, in order: category and the parts of a text that mean it, the direct ones and then the wider ones.
PARTS: list[tuple[str, str]] = [
    ("MUSIC", "muziek|concert|optreden|festival|band|dj"),
    ("ACTIVE", "sport|yoga|wandeling|hardlopen|fietsen|fitness"),
    ("CULTURE", "theater|theatre|museum|film|bioscoop|tentoonstelling|kunst|workshop|cursus|gaming"),
    ("FOOD", "eten|restaurant|culinair|markt|market"),
    ("NIGHTLIFE", "club|feest|uitgaan|disco|party"),
    ("SOCIAL", "netwerken|networking|meetup"),
    ("FAMILY", "kinderen|familie|kids|gezin"),
    ("CIVIC", "politiek|gemeente|gemeenteraad"),
    ("ACTIVE", "sport|fitness|hardlopen|wielrennen|fietsen|zwemmen|wandelen|yoga|bootcamp|marathon|trimloop|atletiek|gym|crossfit|voetbal|ajax|feyenoord|psv|tennis|hockey|basketbal|volleybal|running|cycling|swimming|walking|workout|soccer|football|volleyball"),
    ("CULTURE", "gaming|esports|spelletjes|bordspellen|videogames|lan-party|gamenight|spellenavond|dungeons|roleplay|video games|board games|tabletop|lan party"),
    ("CULTURE", "theater|film|bioscoop|comedy|cabaret|musical|show|voorstelling|stand-up|circus|entertainment|optreden|cinema|performance"),
    ("SOCIAL", "borrel|vrijmibo|vrijdagmiddag|netwerken|networking|meetup|ontmoeting|drink|happy hour|afterwork|bijeenkomst|sociaal|social|gathering"),
    ("FAMILY", "kinderen|kids|familie|gezin|jeugd|basisschool|speeltuin|kinderopvang|zwemles|voorlezen|knutselen|familiedag|kinderfestival|peutergroep|children|family|youth|playground|daycare|swimming lessons|craft|reading"),
    ("ACTIVE", "natuur|buiten|outdoor|wandeling|excursie|fietstocht|vogelen|kamperen|picknick|park|bos|strand|duinen|nature|hiking|excursion|cycling tour|birdwatching|camping|picnic|forest|beach"),
    ("MUSIC", "concert|muziek|festival|live|optreden|band|dj|jazz|klassiek|pop|rock|dance|techno|house|openlucht|music|performance|classical"),
    ("CULTURE", "workshop|cursus|les|training|masterclass|lezing|college|leren|creatief|koken|schilderen|fotograferen|ambacht|course|lesson|lecture|learning|creative|cooking|painting|photography|craft"),
    ("FOOD", "eten|food|proeverij|wijn|bier|culinair|restaurant|markt|foodtruck|koken|smaak|diner|lunch|high tea|borrelhapjes|tasting|wine|beer|culinary|market|food truck|cooking|dinner"),
    ("COMMUNITY", "buurt|wijk|gemeente|vrijwilliger|inspraak|bewoners|vereniging|stichting|lokaal|samen|participatie|buurthuis|wijkcentrum|neighborhood|community|volunteer|local|together|participation|community center"),
]
#: Categories as they are stored, and the older keys and what they became.
STORED = "MUSIC CULTURE COMMUNITY SOCIAL ACTIVE FOOD NIGHTLIFE FAMILY OUTDOOR SPORTS CINEMA CRAFTS GAMING MARKET WELLNESS".split()
OLDER = {
    "music": "MUSIC", "active": "ACTIVE", "social": "SOCIAL", "family": "FAMILY", "foodie": "FOOD", "food": "FOOD", "entertainment": "CULTURE", "gaming": "CULTURE", "workshops": "CULTURE",
    "arts": "CULTURE", "outdoors": "ACTIVE", "sports": "ACTIVE", "wellness": "ACTIVE", "nightlife": "NIGHTLIFE", "club": "NIGHTLIFE", "community": "COMMUNITY", "market": "FOOD",
    "crafts": "CULTURE", "cinema": "CULTURE",
}
#: Fixed values of the migration of stored events.
MIGRATED: list[tuple[str, tuple[str, ...]]] = [
    ("MUSIC", ("music",)), ("ACTIVE", ("active", "outdoors", "sports", "wellness", "fitness")), ("SOCIAL", ("social",)), ("FAMILY", ("family",)), ("FOOD", ("foodie", "market", "crafts", "food")),
    ("CULTURE", ("entertainment", "gaming", "workshops", "arts", "cinema", "theater", "theatre")), ("NIGHTLIFE", ("nightlife", "club", "party")),
]
#: Parts of an image's address that rule it out, and patterns one of which it needs.
NO_IMAGE = ("facebook.com/tr", "google-analytics", "googletagmanager", "doubleclick", "/pixel", "/logo", "logo.svg", "logo.png", "og-image", "share-", "favicon", "1x1", "spacer")
IMAGE = r"\.(?i:jpg|jpeg|png|webp|gif)|assets\.|images/|media/|cdn\.|cloudfront"
#: Titles and paths of pages that aren't one event's.
GENERIC_TITLE = r"(?i)^(?:concerten in|events? in|agenda|calendar|upcoming events|archive of|membership|lidmaatschap|visit |rondleiding|festivals en specials|ticket to the|indiestad$|super-sonic jazz$|tones$|kosmos$|sugar mountain)"
LISTING_PATH = r"^/?(?:en|nl)?/?(?:agenda|events|calendar|programma|concerten)?/?$|/b/netherlands|/metro-areas/|/concerten-en-tickets/?$|/live-music-calendar/?$"
OTHER_PATH = r"/subbrand/|/archive/?$|/membership/?$|/lidmaatschap|/visit/?$|/themes?/|/themas?/|/rondleidingen|/serie/|/abonnement|/pers/?$|/zakelijk"
EVENT_PATH = "event|ticket|concert|show|workshop"
#: Parts of a URL that is no event's image but counts visits, and of domains that aren't looked at.
TRACKING = "facebook.com/tr|doubleclick|googletagmanager|google-analytics|analytics|pixel|adsystem"
NOISE_DOMAINS = "tripadvisor.|facebook.com|booking.com|instagram.com|twitter.com|x.com|linkedin.com|pinterest.com|youtube.com|tiktok.com|yelp.|groupon.|expedia.|hotels.|airbnb.|marktplaats.nl|wikipedia.org"
#: Signs of an event in a URL or its snippet.
EVENT_SIGNS = "event|agenda|calendar|programma|tickets|concerten|festival|theater|uitagenda|evenement|activiteit"
EVENT_DATE = r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{1,2}\s+(jan|feb|mrt|apr|mei|jun|jul|aug|sep|okt|nov|dec)"
#: Tags of each category.
TAGS = {
    "MUSIC": "concert live jazz band dj klassiek pop rock orkest koor jam-sessie recital", "SOCIAL": "networking drink meetup borrel vrijmibo speeddate ontmoeting netwerk netwerken",
    "ACTIVE": "yoga hiking run sport fitness dansles bootcamp surfen zeilen wandeling", "CULTURE": "film art theater museum expositie kunst cabaret comedy workshop cursus poëzie lezing",
    "FOOD": "market wine beer proeverij brunch diner lunch streekmarkt", "NIGHTLIFE": "rave techno house club party festival dj", "FAMILY": "kids family fair speeltuin kinderboerderij jeugd",
    "CIVIC": "buurt service vrijwilliger gemeente politiek inspraak", "COMMUNITY": "buurt vrijwilliger",
}
#: Fixed values, in order: how a page writes a time; what stands before the hours, and what behind the minutes.
_HALF = r"(?:\s*(am|pm))?"
_AT = r"(\d{1,2})[.:h](\d{2})"
PAGE_TIMES = [
    rf"aanvang[:\s]*{_AT}{_HALF}", rf"vanaf\s+{_AT}{_HALF}", rf"{_AT}\s*uur()", rf"beginn[:\s]*{_AT}{_HALF}", rf"ab\s+{_AT}{_HALF}", rf"{_AT}\s*uhr()", rf"starts?\s*(?:at\s*)?{_AT}{_HALF}", rf"from\s+{_AT}{_HALF}",
    rf"doors?\s*(?:open\s*)?(?:at\s*)?{_AT}{_HALF}", rf"start[:\s]*(?:om\s*)?{_AT}{_HALF}", rf"time[:\s]*{_AT}{_HALF}", rf"om\s+{_AT}{_HALF}", rf"(\d{{1,2}})[.:](\d{{2}})\s*[-–—]\s*\d{{1,2}}[.:]\d{{2}}{_HALF}", rf"{_AT}\s*(am|pm)?",
]
#: Part of a URL, its fetcher, what to wait for, and whether it guards against robots; in order.
KNOWN_DOMAINS = [
    ("eventbrite.com", "playwright", ".event-card", False), ("meetup.com", "playwright", "[data-event-id]", False), ("facebook.com", "browserless", None, True), ("ra.co", "browserless", ".listing", True),
    ("bandsintown.com", "browserless", "body", True), ("ticketmaster.nl", "playwright", ".event-listing", True), ("uitagenda.nl", "static", None, False), ("ontdekeindhoven.nl", "static", None, False), ("vvv", "static", None, False),
]
NEEDS_SCRIPT = r"__NEXT_DATA__|react-root|ng-app|data-reactid|window\.__INITIAL_STATE__|window\.Webflow|<noscript>.*(?i:enable JavaScript)"
GUARDED = r"(?i)captcha|cloudflare|challenge-form|turnstile|recaptcha|hcaptcha|Are you a robot|Checking your browser"
#: Fixed values of the fetcher's recommendation: weight, fetcher that it speaks for (negative: for static), and the test of a page.
SIGNALS: list[tuple[float, str, str]] = [
    (0.9, "puppeteer", r"""id="root"|id="__next"|data-reactroot|__REACT_ROOT__"""), (0.7, "puppeteer", "__NEXT_DATA__"), (0.7, "puppeteer", "__NUXT__"), (0.9, "puppeteer", "ng-app|ng-version|_ngcontent"),
    (0.85, "puppeteer", "svelte-|__svelte"), (0.6, "puppeteer", r"""data-src=|lazyload|loading="lazy\""""), (0.7, "puppeteer", "infinite-scroll|loadMore|load-more"), (0.8, "puppeteer", r"pushState|replaceState|history\.push"),
    (0.95, "scrapingbee", "cf-browser-verification|cloudflare|cf-ray"), (0.9, "scrapingbee", "recaptcha|grecaptcha"), (0.85, "scrapingbee", "bot-detect|are you human|verify you are not a robot"),
    (0.5, "static", r"application/ld\+json"), (0.6, "static", r"application/rss\+xml|application/atom\+xml"), (0.3, "static", "wp-content|wordpress"),
]
PRIOR = {"static": 0.3, "puppeteer": 0.1, "playwright": 0.05, "scrapingbee": 0.0}


def _known(mapping: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), key)


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def category_by_parts(text: Column) -> Column:
    """The category of the first rule of which the text holds a part, anywhere in a word; else COMMUNITY."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(any_part(lower, FAMILY_FIRST), "FAMILY").when(any_part(lower, SOCIAL_FIRST), F.when(any_part(lower, SOCIAL_FOOD), "FOOD").otherwise("SOCIAL"))
    for name, parts in PARTS:
        out = out.when(any_part(lower, parts), name)
    return out.otherwise("COMMUNITY")


def stored_category(category: Column) -> Column:
    upper = F.upper(category)
    plural = F.when(upper == "OUTDOORS", "outdoor").when(upper.isin(*STORED), F.lower(upper)).otherwise(F.lower(category))
    return F.when(_blank(category), "community").otherwise(plural)


def older_category(category: Column) -> Column:
    return F.coalesce(_known(OLDER, F.lower(category)), F.lit("COMMUNITY"))


def migrated_category(category: Column) -> Column:
    out = None
    for name, keys in MIGRATED:
        test = F.lower(category).isin(*keys)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("COMMUNITY")


def is_web_address(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://[^\s/?#]+"), F.lit(False))


def quick_error(name: Column, source_url: Column, category: Column) -> Column:
    """The first thing that is missing; null for a valid event."""
    return F.when(_blank(name) | (F.length(name) < 3), "Missing or invalid name").when(_blank(source_url), "Missing source_url").when(_blank(category), "Missing category")


def strategy_error(name: Column, city: Column, start_time: Column, ticket_url: Column) -> Column:
    iso = start_time.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}.*)?$") & F.substring(start_time, 1, 10).try_cast("date").isNotNull()
    return (
        F.when(_blank(name) | (F.length(F.trim(name)) < 3), "Event name is required and must be at least 3 characters").when(_blank(city), "City is required")
        .when(~_blank(start_time) & ~F.coalesce(iso, F.lit(False)), "Invalid start_time format (expected ISO 8601)").when(~_blank(ticket_url) & ~is_web_address(ticket_url), "Invalid ticket_url format")
    )


def is_event_image(url: Column) -> Column:
    lower = F.lower(F.coalesce(url, F.lit("")))
    ruled_out = F.lit(False)
    for part in NO_IMAGE:
        ruled_out = ruled_out | lower.contains(part)
    return ~ruled_out & F.coalesce(url.rlike(IMAGE), F.lit(False))


def url_path(url: Column) -> Column:
    """The lower-case path; a slash where there is none."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/")))


def is_listing_page(url: Column) -> Column:
    """Whether a URL's path is a list's or another page's than an event's: by pattern, short without a date, or ending in a small number."""
    path = url_path(url)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    dated = path.contains("-20") | path.rlike(r"\d{2}-\d{2}-\d{2,4}")
    short = (F.size(parts) <= 2) & ~dated & (~path.rlike(EVENT_PATH) | (F.size(parts) < 2))
    number = F.coalesce(F.try_element_at(parts, F.lit(-1)).rlike(r"^0*\d{1,4}$"), F.lit(False))
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://") & (path.rlike(LISTING_PATH) | path.rlike(OTHER_PATH) | short | number)


def is_tracking_url(url: Column) -> Column:
    return any_part(F.lower(url), TRACKING)


def is_noise_domain(domain: Column) -> Column:
    lower = F.lower(domain)
    out = F.lit(False)
    for part in NOISE_DOMAINS.split("|"):
        out = out | lower.contains(part)
    return out


def is_event_url(url: Column, snippet: Column) -> Column:
    both = F.concat(F.lower(url), F.lit(" "), F.lower(snippet))
    return any_part(both, EVENT_SIGNS) | F.lower(snippet).rlike(EVENT_DATE)


def tags_in(text: Column, category: Column) -> Column:
    """The category's tags that the text holds, in the order of their list."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    known = F.create_map(*[x for name, tags in TAGS.items() for x in (F.lit(name), F.array(*[F.lit(t) for t in tags.split()]))])
    return F.coalesce(F.filter(F.try_element_at(known, category), lambda t: lower.contains(t)), F.array().cast("array<string>"))


def written_time(text: Column) -> Column:
    """HH:MM by the first of PAGE_TIMES whose hours are possible, in 24 hours."""
    lower = F.lower(text)
    found = []
    for pattern in PAGE_TIMES:
        hours, half = F.nullif(F.regexp_extract(lower, pattern, 1), F.lit("")).cast("int"), F.regexp_extract(lower, pattern, 3)
        hours = F.when((half == "pm") & (hours < 12), hours + 12).when((half == "am") & (hours == 12), 0).otherwise(hours)
        found.append(F.when(hours <= 23, F.concat(F.lpad(hours.cast("string"), 2, "0"), F.lit(":"), F.regexp_extract(lower, pattern, 2))))
    return F.coalesce(*found)


def repaired_json(text: Column) -> Column:
    """Valid JSON as it is; else without trailing commas, with double quotes and quoted keys, if that is valid; else null."""
    fixed = F.regexp_replace(text, r",\s*([}\]])", "$1")
    fixed = F.regexp_replace(F.replace(fixed, F.lit("'"), F.lit('"')), r"([{,])\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*:", '$1"$2":')
    fixed = F.regexp_replace(fixed, r"[\x00-\x1F\x7F]", "")
    return F.when(F.try_parse_json(text).isNotNull(), text).when(F.try_parse_json(fixed).isNotNull(), fixed)


def curated_errors(has_data: Column, source_url: Column, title: Column, city: Column, start: Column) -> Column:
    """What makes an extracted event invalid. A missing record, and a listing page, say nothing else."""
    rest = F.array_compact(F.array(
        F.when(_blank(title), F.lit("Missing event title")), F.when(title.rlike(GENERIC_TITLE), F.lit("Generic/non-event page title detected")), F.when(_blank(city), F.lit("Missing city")),
        F.when(~_blank(start) & start.try_cast("timestamp").isNull(), F.lit("Invalid start datetime")),
    ))
    return F.when(~has_data, F.array(F.lit("No data extracted"))).when(F.coalesce(is_listing_page(source_url), F.lit(False)), F.array(F.lit("Extracted from listing page, not event detail"))).otherwise(rest)


def curated_warnings(start: Column, description: Column, image_url: Column, confidence: Column, complete: Column, now: Column) -> Column:
    n = F.coalesce(F.length(description), F.lit(0))
    return F.array_compact(F.array(
        F.when(_blank(start), F.lit("No start datetime")).when(start.try_cast("timestamp") < now, F.lit("Event is in the past")),
        F.when(n < 20, F.concat(F.lit("Short description ("), n.cast("string"), F.lit(" chars)"))), F.when(n == 0, F.lit("Empty description")),
        F.when(~is_event_image(image_url), F.lit("Invalid or missing event image")),
        F.when((confidence != 0) & (confidence < 0.3), F.concat(F.lit("Low extraction confidence: "), confidence.cast("string"))),
        F.when((complete != 0) & (complete < 0.4), F.concat(F.lit("Low data completeness: "), complete.cast("string"))),
    ))


def fetch_strategy(url: Column, html: Column) -> Column:
    """struct<fetcher, wait_for, anti_bot, timeout_ms>: a known domain's, else by what the page shows."""
    strategy = lambda fetcher, wait, guarded, timeout: F.struct(F.lit(fetcher).alias("fetcher"), F.lit(wait).cast("string").alias("wait_for"), F.lit(guarded).alias("anti_bot"), F.lit(timeout).alias("timeout_ms"))
    out = None
    for part, *known in KNOWN_DOMAINS:
        chosen = strategy(*known, 30000)
        out = F.when(url.contains(part), chosen) if out is None else out.when(url.contains(part), chosen)
    return out.when(html.isNull(), strategy("playwright", None, False, 15000)).when(html.rlike(GUARDED), strategy("browserless", None, True, 15000)).when(html.rlike(NEEDS_SCRIPT), strategy("playwright", None, False, 15000)).otherwise(strategy("static", None, False, 15000))


def recommended_fetcher(html: Column, failures: Column, success_rate: Column, average_events: Column) -> Column:
    """struct<fetcher, confidence>: priors and the weights of a page's signals by fetcher; the largest, in the fetchers' order, over the sum."""
    n = F.length(html)
    text = F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", ""), r"\s+", " "))
    scores = {k: F.lit(v) for k, v in PRIOR.items()}
    tests = [(w, f, html.rlike(p)) for w, f, p in SIGNALS]
    tests += [(0.9, "puppeteer", html.contains('id="app"') & html.contains("v-")), (0.4, "static", (n > 5000) & (F.regexp_count(html, F.lit("<!--")) > 3))]
    tests += [(0.5, "puppeteer", n < 1000), (0.5, "puppeteer", (n > 1000) & (F.length(text) < 200)), (0.4, "puppeteer", (success_rate < 0.5) & (average_events > 0))]
    for weight, fetcher, test in tests:
        scores[fetcher] = scores[fetcher] + F.when(test, weight).otherwise(0.0)
    scores["puppeteer"] = scores["puppeteer"] + F.when(failures >= 3, failures * 0.3).otherwise(0.0)
    ordered = F.array(*[F.struct(scores[k].alias("score"), F.lit(-i).alias("place"), F.lit(k).alias("fetcher")) for i, k in enumerate(PRIOR)])
    total = F.aggregate(ordered, F.lit(0.0), lambda s, x: s + x["score"])
    return F.struct(F.array_max(ordered)["fetcher"].alias("fetcher"), (F.array_max(ordered)["score"] / total).alias("confidence"))


def healing_confidence(events: Column, expected: Column, valid_fields: Column, fields: int = 3) -> Column:
    """A half; a fifth for any event, up to 0.15 for the expected number, and up to 0.15 for the required fields that match."""
    near = F.when(expected > 0, F.least(events, expected) / F.greatest(events, expected) * 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(0.5) + F.when(events > 0, 0.2 + F.coalesce(near, F.lit(0.0))).otherwise(0.0) + valid_fields / F.lit(fields) * 0.15)


def class_matches(html: Column, name: str) -> Column:
    """How many elements have the class, as a word of their class attribute."""
    return F.regexp_count(html, F.lit(rf"""(?i)class=["'][^"']*\b{name}\b[^"']*["']"""))


def repeated_classes(html: Column, least: int = 3, most: int = 50) -> Column:
    """Class names that stand on 3 to 50 elements and aren't generated ones, in alphabetical order."""
    names = F.split(F.array_join(F.regexp_extract_all(html, F.lit("""(?i)class=["']([^"']+)["']"""), F.lit(1)), " "), r"\s+")
    names = F.filter(names, lambda c: (F.length(c) > 2) & ~c.rlike("^(css-|_|sc-)"))
    times = lambda c: F.size(F.filter(names, lambda x: x == c))
    return F.array_sort(F.filter(F.array_distinct(names), lambda c: times(c).between(least, most)))


#: Dutch months in full, as the loose date reads them.
_MONTHS = "januari februari maart april mei juni juli augustus september oktober november december".split()


def loose_date(text: Column) -> Column:
    """The text itself if it holds an ISO date, a Dutch date in full as ISO, else null."""
    dutch = rf"(\d{{1,2}})\s*({'|'.join(_MONTHS)})\s*(\d{{4}})"
    lower = F.lower(text)
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.regexp_extract(lower, dutch, 2)).cast("int")
    written = F.format_string("%s-%02d-%s", F.regexp_extract(lower, dutch, 3), month, F.lpad(F.regexp_extract(lower, dutch, 1), 2, "0"))
    return F.when(text.rlike(r"\d{4}-\d{2}-\d{2}"), text).when(lower.rlike(dutch), written)


def _hours_minutes(text: Column, pattern: str) -> Column:
    hours = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.concat(F.lpad(hours, 2, "0"), F.lit(":"), F.regexp_extract(text, pattern, 2))


def repaired_time(time: Column, otherwise: Column | None = None) -> Column:
    """HH:MM stays, another notation of hours and minutes becomes it, and the rest stays or becomes `otherwise`."""
    found = _hours_minutes(time, r"(\d{1,2})[:.](\d{2})")
    return F.when(_blank(time) | time.rlike(r"^\d{2}:\d{2}$"), time).otherwise(F.coalesce(found, time if otherwise is None else otherwise))


def repaired_date(date: Column, hint: Column) -> Column:
    return F.when(~_blank(date) & ~date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.coalesce(loose_date(hint), date)).otherwise(date)


def repaired_tags(tags: Column, language: Column) -> Column:
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    return F.when(language.isin("EN", "Mixed") & ~F.array_contains(tags, "ExpatFriendly"), F.array_append(tags, "ExpatFriendly")).otherwise(tags)


def page_title(html: Column) -> Column:
    """og:title, else the title up to a bar, else the first heading."""
    own = first_match(html, r"(?i)<title>([^<]+)</title>")
    return F.coalesce(first_match(html, r"""(?i)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']+)["']"""), F.trim(F.split_part(own, F.lit("|"), F.lit(1))), F.trim(first_match(html, r"(?i)<h1[^>]*>([^<]+)</h1>")))


def page_time(html: Column) -> Column:
    return F.coalesce(*[_hours_minutes(html, p) for p in (r"(\d{2}):(\d{2})", *[rf"(?i){word}[:\s]*(\d{{1,2}})[:.](\d{{2}})" for word in ("aanvang", "start", "begint?", "doors?")])])


def page_venue(html: Column) -> Column:
    return F.coalesce(first_match(html, r'(?i)"location"\s*:\s*\{[^}]*"name"\s*:\s*"([^"]+)"'), F.trim(first_match(html, r"""(?i)class=["'][^"']*venue[^"']*["'][^>]*>([^<]+)""")))


def page_description(html: Column) -> Column:
    return first_match(html, *[rf"""(?i)<meta[^>]+{at}["'][^>]+content=["']([^"']+)["']""" for at in ("""property=["']og:description""", """name=["']description""")])


_NUMBER = r"\s*(-?\d+(?:\.\d+)?)"
#: Addresses of maps with a latitude and a longitude in them.
_MAPS = (
    r"(?i)google\.com/maps[^\"'\s]*?@(-?\d+(?:\.\d+)?),(-?\d+(?:\.\d+)?)",
    r"(?i)google\.com/maps[^\"'\s]*?!3d(-?\d+(?:\.\d+)?)!4d(-?\d+(?:\.\d+)?)",
    r"(?i)google\.com/maps[^\"'\s]*?center=(-?\d+(?:\.\d+)?),(-?\d+(?:\.\d+)?)",
    r"(?i)google\.com/maps[^\"'\s]*?ll=(-?\d+(?:\.\d+)?),(-?\d+(?:\.\d+)?)",
    r"(?i)google\.com/maps[^\"'\s]*?q=(-?\d+(?:\.\d+)?),(-?\d+(?:\.\d+)?)",
    r"(?i)openstreetmap\.org[^\"'\s]*#map=\d+/(-?\d+(?:\.\d+)?)/(-?\d+(?:\.\d+)?)",
)


def _meta(at: str, name: str) -> tuple[str, str]:
    """A meta tag's number with its name before its content, and the other way round."""
    return rf"""(?i)<meta[^>]*{at}=["']{name}["'][^>]*content=["']{_NUMBER}""", rf"""(?i)<meta[^>]*content=["']{_NUMBER}[^"']*["'][^>]*{at}=["']{name}["']"""


def _meta_pair(name: str, between: str) -> tuple[str, str]:
    """A meta tag with both numbers in its content."""
    both = rf"{_NUMBER}{between}{_NUMBER}"
    return rf"""(?i)<meta[^>]*name=["']{name}["'][^>]*content=["']{both}""", rf"""(?i)<meta[^>]*content=["']{both}[^"']*["'][^>]*name=["']{name}["']"""


def _single(name: str) -> tuple[str, ...]:
    return (rf"""(?i)<[^>]*itemprop=["']{name}["'][^>]*(?:content=["']|>){_NUMBER}""", rf"""(?i)<[^>]*content=["']{_NUMBER}["'][^>]*itemprop=["']{name}["']""")


#: Where a page says where it is, beyond JSON-LD, in order: source, confidence, forms of the latitude and
#: of the longitude; where the second are none, the first hold both.
PLACES: list[tuple[str, float, tuple[str, ...], tuple[str, ...]]] = [
    ("microdata", 0.9, _single("latitude"), _single("longitude")),
    ("opengraph", 0.9, _meta("property", "place:location:latitude"), _meta("property", "place:location:longitude")),
    ("opengraph", 0.85, _meta("property", "og:latitude"), _meta("property", "og:longitude")),
    *[("embed", 0.85, (p,), ()) for p in _MAPS],
    ("meta", 0.85, _meta_pair(r"geo\.position", "[;,]"), ()),
    ("meta", 0.8, _meta_pair("ICBM", r"[,\s]+"), ()),
]


def _coordinates(lat: Column, lng: Column, source: str, confidence: float) -> Column:
    good = lat.between(-90, 90) & lng.between(-180, 180) & ~((lat == 0) & (lng == 0))
    return F.when(good, F.struct(lat.alias("lat"), lng.alias("lng"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence")))


def json_ld_coordinates(html: Column) -> Column:
    """Of JSON-LD: an Event's place with geo (0.95), a Place with geo or bare GeoCoordinates (0.9), the first that is valid."""

    def place(v: Column) -> Column:
        number = lambda at, names: F.coalesce(*[F.try_variant_get(v, f"{at}.{n}", "string").try_cast("double") for n in names])
        here = lambda at, confidence: _coordinates(number(at, ("latitude", "lat")), number(at, ("longitude", "lng", "lon")), "jsonld", confidence)
        kind = F.try_variant_get(v, '$["@type"]', "string")
        return F.when(kind == "Event", here("$.location.geo", 0.95)).when(kind == "Place", here("$.geo", 0.9)).when(kind == "GeoCoordinates", here("$", 0.9))

    return F.get(F.filter(F.transform(structured.json_ld_nodes(html), place), lambda c: c.isNotNull()), F.lit(0))


def page_coordinates(html: Column) -> Column:
    """struct<lat, lng, source, confidence> of the first place on a page whose coordinates are valid; null for short pages."""
    found = [json_ld_coordinates(html)]
    for source, confidence, at, then in PLACES:
        read = lambda forms, group: F.coalesce(*[F.regexp_extract(html, form, group).try_cast("double") for form in forms])
        found.append(_coordinates(read(at, 1), read(then, 1) if then else read(at, 2), source, confidence))
    return F.when(F.length(html) >= 100, F.coalesce(*found))
