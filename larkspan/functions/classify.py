"""Category, language, interaction and validity rules. Word lists and thresholds are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.geo import valid_coordinates
from larkspan.functions.text import any_part

#: Fixed values, in order: category, whole words that mean it, and parts of a URL that do.
CATEGORY_WORDS: list[tuple[str, str, str]] = [
    ("NIGHTLIFE", "club|disco|uitgaan|feest|dansen|nachtleven|party|rave|techno|house|nachtclub|nachtmarkt|nightclub|dance|nightlife|clubbing", "/club|/party|/nightlife"),
    ("FOOD", "proeverij|culinair|restaurant|foodtruck|wijn|bier|lunch|streekmarkt|gastronomie|tasting|culinary|food truck|wine|beer|gastronomy", "/food|/restaurant|/markt|/market"),
    ("FAMILY", "kinderen|familie|gezin|kids|jeugd|basisschool|speeltuin|kinderfestival|kinderboerderij|kermis|children|family|youth|playground|family-friendly|petting zoo|fair", "/kids|/family|/kinderen"),
    ("MUSIC", "muziek|optreden|concert|band|dj|jazz|klassiek|pop|rock|live|zanger|zangeres|orkest|koor|jam-sessie|recital|music|gig|festival|performance|live music|classical|singer|orchestra|choir|jam session", "/concert|/muziek|/music|/live"),
    ("CULTURE", "theater|museum|tentoonstelling|kunst|film|bioscoop|voorstelling|cabaret|comedy|workshop|cursus|gaming|expositie|poëzie|literatuur|lezing|bibliotheek|theatre|exhibition|art|cinema|show|course|poetry|literature|lecture|library", "/theater|/museum|/art|/workshop|/expositie|/lezing"),
    ("ACTIVE", "sport|yoga|wandeling|hardlopen|fietsen|fitness|gym|marathon|voetbal|tennis|zwemmen|dansles|bootcamp|surfen|zeilen|stadsommetje|sports|hiking|running|cycling|workout|football|soccer|swimming|dance class|surfing|sailing", "/sport|/fitness|/yoga"),
    ("SOCIAL", "borrel|netwerken|meetup|vrijmibo|vrijdagmiddag|networking|drink|sociaal|afterwork|ontmoeting|bijeenkomst|gezelligheid|speeddate|vereniging|drinks|social|happy hour|gathering|networking event|speed dating|club meeting", "/networking|/meetup|/social"),
    ("CIVIC", "politiek|gemeente|inspraak|vergadering|gemeenteraad|overheid|vrijwilliger|buurt|wijkreünie|town hall|politics|municipality|civic|meeting|government|council|volunteer|neighborhood|service", "/gemeente|/civic|/politics"),
]
#: Fixed values of the language profile.
DUTCH_WORDS = (
    "het een van dat niet voor zijn maar ook naar deze meer kan nog wel moet jouw geen wordt worden alle hier daar veel door gratis "
    "aanvang zaal deuren entree toegang reserveren kaartjes kaarten ingang uitgang programma voorstelling optreden "
    "maandag dinsdag woensdag donderdag vrijdag zaterdag zondag januari februari maart april mei juni juli augustus september oktober november december "
    "uur minuten morgen vanmiddag vanavond vannacht tegen tijdens tussen volgens vanuit vanaf omheen langs behalve ondanks binnen buiten zonder "
    "ik jij hij zij wij jullie hun haar mijn onze ons hen wie wat waar wanneer hoe"
).split()
DUTCH_ENDINGS = ("heid", "lijk", "isch", "atie", "eren", "ing", "isme", "isten")
DUTCH_PAIRS = ("ij", "ee", "oo", "aa", "uu")
ENGLISH_WORDS = (
    "the of and to in is you that it for are with as at this but his by from they we say her she or an will my one all would there their what so up out if about "
    "doors entry tickets show concert venue event registration free admission starts opens ends monday tuesday wednesday thursday friday saturday sunday "
    "january february march april may june july august september october november december"
).split()
ENGLISH_MARKS = ("in english", "english spoken", "english language", "performed in english", "presented in english", "english subtitles", "international event", "all english", "expats welcome")
#: Titles that aren't events.
NOISE = r"^reactie op|^comment on|^re:|antwoorden$|reply$|leestijd|geschreven door|posted by|ticketprijs bij evenement|^geen evenement|^foto|door een bezoeker"
#: Interaction rules, in order; then the generic categories.
INTERACTION: list[tuple[str, str]] = [
    ("high", r"workshop|masterclass|cursus|les\b|training|netwerk|network|meetup|meet-up|borrel|drinks?|social\s+event|speed\s*dat|pub\s*quiz|trivia|game\s*night|spel|karaoke|dance\s*class|dansles|yoga|fitness|wandel|walk|tour\b|rondleiding|proeverij|tasting"),
    ("medium", r"concert|festival|markt|market|fair\b|beurs|braderie|open\s*dag|open\s*day|feest|party|club|disco|dj\s*set|live\s*music|live\s*muziek|dans|dance|sport|wedstrijd|match|race|run\b|loop\b|carnaval|kermis|pride|parade"),
    ("low", r"lezing|lecture|talk\b|presentatie|presentation|seminar|symposium|conferentie|conference|debat|debate|discussie|panel|q\s*&\s*a|signing|meet\s*&\s*greet|boek|book\s*launch|reading|voorlees|interview"),
    ("passive", r"film\b|movie|bioscoop|cinema|screening|vertoning|theater|theatre|toneel|musical|opera|ballet|dans\s*voorstelling|show\b|voorstelling|performance|expositie|exhibition|tentoonstelling|museum|galerie|gallery|stand-up|comedy|cabaret"),
]
GENERIC = {
    "WORKSHOP": "high", "NETWORKING": "high", "MEETUP": "high", "SPORTS": "medium", "FOOD": "high", "MUSIC": "medium", "FESTIVAL": "medium", "MARKET": "medium", "NIGHTLIFE": "medium",
    "LECTURE": "low", "EDUCATION": "low", "SEMINAR": "low", "CINEMA": "passive", "THEATER": "passive", "EXHIBITION": "passive", "CULTURE": "passive", "MUSEUM": "passive",
}


def category(text: Column, url: Column | None = None, default: Column | None = None) -> Column:
    """The first category that the URL names, else the first of which the text has a whole word, else the default, else COMMUNITY."""
    text = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for name, _, parts in CATEGORY_WORDS if url is not None else ():
        out = F.when(url.rlike(f"(?i){parts}"), name) if out is None else out.when(url.rlike(f"(?i){parts}"), name)
    words = F.array_distinct(F.split(text, "[^a-z0-9_]+"))
    tests = []
    for name, alternatives, _ in CATEGORY_WORDS:
        single = [w for w in alternatives.split("|") if w.isascii() and w.isalnum()]
        phrases = [w for w in alternatives.split("|") if w not in single]
        tests.append((name, single, [(w, rf"(?:^|[^A-Za-z0-9_]){w}(?:$|[^A-Za-z0-9_])") for w in phrases]))

    def by_words(x: Column) -> Column:
        found = None
        for name, single, phrases in tests:
            test = F.arrays_overlap(x["words"], F.array(*[F.lit(w) for w in single]))
            for phrase, bounded in phrases:
                test = test | (x["text"].contains(phrase) & x["text"].rlike(bounded))
            found = F.when(test, name) if found is None else found.when(test, name)
        return found

    # An array of one, so that the text is split once.
    named = F.get(F.transform(F.array(F.struct(text.alias("text"), words.alias("words"))), by_words), F.lit(0))
    out = F.when(named.isNotNull(), named) if out is None else out.when(named.isNotNull(), named)
    return out.otherwise(F.coalesce(default, F.lit("COMMUNITY")) if default is not None else F.lit("COMMUNITY"))


def is_probable_event(title: Column) -> Column:
    lower = F.lower(F.coalesce(title, F.lit("")))
    return ~any_part(lower, NOISE) & (F.length(lower) >= 5) & ~lower.isin("admin", "geen titel", "no title", "anonymous")


def language_profile(text: Column) -> Column:
    """struct<language, dutch_score, english_score> by points for words, endings, letter pairs and plain statements."""
    lower = F.lower(F.coalesce(text, F.lit("")))

    def counted(x: Column) -> Column:
        words, lower = x["words"], x["lower"]
        many = lambda test: F.size(F.filter(words, test))
        pair = {p: (F.length(lower) - F.length(F.replace(lower, F.lit(p), F.lit("")))) / 2 for p in DUTCH_PAIRS}
        dutch = 2 * many(lambda w: w.isin(*DUTCH_WORDS)) + many(lambda w: w.rlike(f"^[a-z]{{3,}}(?:{'|'.join(DUTCH_ENDINGS)})$"))
        dutch = dutch + sum((F.when(n > 2, F.least(n, F.lit(5.0))).otherwise(0.0) for n in pair.values()), F.lit(0.0))
        dutch = dutch + F.when(pair["ij"] >= 2, 2 * pair["ij"]).otherwise(0.0)
        english = 2 * many(lambda w: w.isin(*ENGLISH_WORDS)) + sum((F.when(lower.contains(m), 10).otherwise(0) for m in ENGLISH_MARKS), F.lit(0))
        enough = (F.length(lower) >= 50) & (many(lambda w: w.rlike("^[a-z]{2,}$")) >= 10)
        return F.struct(dutch.alias("dutch"), english.alias("english"), enough.alias("enough"))

    def profile(points: Column) -> Column:
        total = points["dutch"] + points["english"] + 1
        nl, en = F.when(points["enough"], points["dutch"] / total).otherwise(0.0), F.when(points["enough"], points["english"] / total).otherwise(0.0)
        language = (
            F.when(~points["enough"], "Other").when((nl > 0.6) & (en < 0.2), "NL").when((en > 0.6) & (nl < 0.2), "EN").when((nl > 0.3) & (en > 0.3), "Mixed")
            .when(nl > en, "NL").when(en > nl, "EN").otherwise("Other")
        )
        return F.struct(language.alias("language"), nl.alias("dutch_score"), en.alias("english_score"))

    # Arrays of one, so that the text is split once, and the points are counted once.
    split = F.struct(lower.alias("lower"), F.split(lower, "[^a-z0-9_]+").alias("words"))
    return F.get(F.transform(F.transform(F.array(split), counted), profile), F.lit(0))


def interaction_mode(category_: Column, description: Column) -> Column:
    """high, medium, low or passive: the first rule of which the text has a pattern, else the generic category, else medium."""
    text = F.lower(F.concat_ws(" ", F.coalesce(category_, F.lit("")), F.coalesce(description, F.lit(""))))
    out = None
    for mode, pattern in INTERACTION:
        out = F.when(any_part(text, pattern), mode) if out is None else out.when(any_part(text, pattern), mode)
    plain = F.regexp_replace(F.upper(F.coalesce(category_, F.lit(""))), r"[-_\s]", "")
    for name, mode in GENERIC.items():
        out = out.when(plain.contains(name) | F.lit(name).contains(plain), mode)
    return out.otherwise("medium")


def persona_tags(title: Column, description: Column, language: Column, mode: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    any_of = lambda words: text.rlike("|".join(words))
    rules = [
        (language.isin("EN", "Mixed"), "ExpatFriendly"),
        (any_of(("brunch", "morning", "ochtend")), "EarlyBird"),
        (any_of(("night", "avond", "nacht", "late", "laat")), "NightOwl"),
        (any_of(("food", "eten", "culinair", "diner", "lunch", "proeverij")), "Foodie"),
        (any_of(("kid", "child", "kind", "familie", "family", "gezin")), "FamilyFriendly"),
        (any_of(("romantic", "date", "valentijn", "couples", "koppel")), "DateNight"),
        (any_of(("learn", "leer", "discover", "ontdek", "education", "educatie")), "Curious"),
        (mode == "passive", "CultureVulture"),
        (mode == "high", "Curious"),
    ]
    return F.array_distinct(F.array_compact(F.array(*[F.when(test, tag) for test, tag in rules])))


def price_range(text: Column) -> Column:
    """Euro signs by the largest number: up to 15, 40, 100, and more; signs stay, and text without a number too."""
    clean = F.trim(text)
    numbers = F.transform(F.regexp_extract_all(clean, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit(".")).cast("double"))
    top = F.array_max(numbers)
    return F.when(text.isNull(), "").when(clean.rlike("^€{1,4}$") | top.isNull(), clean).when(top <= 15, "€").when(top <= 40, "€€").when(top <= 100, "€€€").otherwise("€€€€")


VALID_CATEGORIES = ("active", "gaming", "entertainment", "social", "family", "outdoors", "music", "workshops", "foodie", "community")


def validation_errors(name: Column, category_: Column, source_url: Column, city: Column) -> Column:
    empty = lambda c: c.isNull() | (c == "")
    return F.array_compact(F.array(
        F.when(empty(name), F.lit("Missing required field: name")),
        F.when(empty(category_), F.lit("Missing required field: category")),
        F.when(empty(source_url), F.lit("Missing required field: source_url")),
        F.when(~empty(name) & (F.length(name) < 3), F.lit("Title too short (min 3 characters)")),
        F.when(empty(city), F.lit("City is required")),
        F.when(~empty(category_) & ~F.lower(category_).isin(*VALID_CATEGORIES), F.concat(F.lit("Invalid category: "), category_)),
        F.when(~empty(source_url) & ~source_url.rlike(r"^https?://[^\s/]+"), F.lit("Invalid source_url")),
    ))


def validation_warnings(name: Column, description: Column, start: Column, end: Column, image_url: Column, lat: Column, lng: Column) -> Column:
    return F.array_compact(F.array(
        F.when(F.length(name) > 500, F.lit("Title truncated (max 500 characters)")),
        F.when(F.length(description) > 5000, F.lit("Description truncated (max 5000 characters)")),
        F.when(end <= start, F.lit("end_time is not after start_time")),
        F.when(~image_url.rlike(r"^https?://[^\s/]+"), F.lit("Invalid image_url")),
        F.when((lat.isNotNull() | lng.isNotNull()) & ~valid_coordinates(lat, lng), F.lit("Invalid coordinates")),
    ))


def european_price(text: Column) -> Column:
    """A price with a decimal comma or point, with or without a currency; null without a number.

    Thousands and decimals together are read as 1.250,50 whichever sign comes first, so 1,250.50 gives 1.2505: that
    is the rule whose results are to be kept.
    """
    clean = F.regexp_replace(text, r"[€$£¥₹\s]", "")
    european = clean.rlike(r"\d+[.,]\d{3}[.,]\d{2}$") | (clean.rlike(r",\d{2}$") & ~clean.rlike(r"\.\d{2}$"))
    plain = F.when(european, F.regexp_replace(F.regexp_replace(clean, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(clean, ",", ""))
    return F.nullif(F.regexp_extract(plain, r"^(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


#: Categories of schema.org types.
SCHEMA_CATEGORIES = {
    "MusicEvent": "MUSIC", "SportsEvent": "ACTIVE", "TheaterEvent": "CULTURE", "DanceEvent": "CULTURE", "ComedyEvent": "CULTURE", "FoodEvent": "FOOD", "Festival": "COMMUNITY",
    "ExhibitionEvent": "CULTURE", "SocialEvent": "SOCIAL", "EducationEvent": "CULTURE",
}


def schema_category(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SCHEMA_CATEGORIES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, kind), F.lit("COMMUNITY"))


#: What each fact of structured data adds to its completeness.
COMPLETENESS = {
    "title": 0.15, "description": 0.10, "event_date": 0.10, "event_time": 0.05, "venue_name": 0.10, "venue_address": 0.05, "image_url": 0.10, "end_time": 0.05, "price": 0.10,
    "tickets_url": 0.05, "organizer": 0.05, "performer": 0.05, "category": 0.05,
}


def completeness(**facts: Column) -> Column:
    """The sum of the weights of the facts that are there; a description counts beyond 50 characters, TBD is no time."""
    score = F.lit(0.0)
    for name, value in facts.items():
        there = value.isNotNull() & (value.cast("string") != "")
        if name == "description":
            there = there & (F.length(value) > 50)
        if name == "event_time":
            there = there & (value != "TBD")
        score = score + F.when(there, COMPLETENESS[name]).otherwise(0.0)
    return F.least(score, F.lit(1.0))
