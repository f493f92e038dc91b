"""Labels, flags and look-ups of events, venues and people. Lists are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.dates import minute_of_day

#: Dutch names of weekdays from Monday and of months, as labels show them.
WEEKDAYS = "maandag dinsdag woensdag donderdag vrijdag zaterdag zondag".split()
SHORT_WEEKDAYS = "ma di wo do vr za zo".split()
MONTHS = "januari februari maart april mei juni juli augustus september oktober november december".split()
SHORT_MONTHS = "jan feb mrt apr mei jun jul aug sep okt nov dec".split()
#: Times that are words, and what they show.
WORDED_TIMES = {"TBD": "", "tbd": "", "Hele dag": "Hele dag", "hele dag": "Hele dag", "all day": "Hele dag", "Avond": "Avond", "avond": "Avond", "Middag": "Middag", "middag": "Middag", "Ochtend": "Ochtend", "ochtend": "Ochtend"}
#: Categories that may begin at midnight.
LATE_CATEGORIES = ("music", "nightlife", "entertainment")
#: Fixed values, in order: a venue's key, its name and city.
VENUES = [
    ("paradiso", "Paradiso", "Amsterdam"), ("ziggo_dome", "Ziggo Dome", "Amsterdam"), ("melkweg", "Melkweg", "Amsterdam"), ("afas_live", "AFAS Live", "Amsterdam"), ("tivolivredenburg", "TivoliVredenburg", "Utrecht"),
    ("ahoy", "Rotterdam Ahoy", "Rotterdam"), ("de_school", "De School", "Amsterdam"), ("shelter", "Shelter", "Amsterdam"), ("de_marktkantine", "De Marktkantine", "Amsterdam"), ("concertgebouw", "Concertgebouw", "Amsterdam"),
    ("carre", "Theater Carré", "Amsterdam"), ("johan_cruijff_arena", "Johan Cruijff ArenA", "Amsterdam"), ("de_kuip", "Stadion Feijenoord (De Kuip)", "Rotterdam"), ("philips_stadion", "Philips Stadion", "Eindhoven"),
]


def _nth(names: list[str], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), place.cast("int"))


def padded_time(time: Column) -> Column:
    """H:MM as HH:MM; other texts stay, null becomes empty."""
    return F.when(time.rlike(r"^\d{1,2}:\d{2}$"), F.lpad(time, 5, "0")).otherwise(F.coalesce(time, F.lit("")))


def time_label(time: Column, all_day: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in WORDED_TIMES.items() for x in pair])
    return F.when(F.coalesce(all_day, F.lit(False)), "Hele dag").when(F.try_element_at(words, time).isNotNull(), F.try_element_at(words, time)).otherwise(padded_time(time))


def _weekday(date: Column) -> Column:
    return F.weekday(date) + 1


def date_label(date: Column, today: Column, full: bool = False) -> Column:
    """Vandaag, Morgen, else `za 18`, or in full `zaterdag 18 mei`."""
    day = F.dayofmonth(date).cast("string")
    plain = F.concat_ws(" ", _nth(WEEKDAYS, _weekday(date)), day, _nth(MONTHS, F.month(date))) if full else F.concat_ws(" ", _nth(SHORT_WEEKDAYS, _weekday(date)), day)
    return F.when(date == today, "Vandaag").when(date == F.date_add(today, 1), "Morgen").otherwise(plain)


def relative_day(date: Column, today: Column) -> Column:
    """Vandaag, Morgen, the weekday within this week (from Monday), else day and short month."""
    same_week = F.date_trunc("week", date) == F.date_trunc("week", today)
    return F.when(date == today, "Vandaag").when(date == F.date_add(today, 1), "Morgen").when(same_week, _nth(WEEKDAYS, _weekday(date))).otherwise(F.concat_ws(" ", F.dayofmonth(date).cast("string"), _nth(SHORT_MONTHS, F.month(date))))


def place_label(name: Column, address: Column, venue: Column) -> Column:
    """The structured name, else its address, else a venue that isn't unknown."""
    filled = lambda c: F.nullif(c, F.lit(""))
    known = F.when(~F.lower(venue).isin("unknown", "unknown location"), filled(venue))
    return F.coalesce(filled(name), filled(address), known, F.lit("Locatie onbekend"))


def closing_time(hours: Column, weekday: Column, time: Column) -> Column:
    """The end of the first of today's ranges that holds the time; malformed ranges are passed over, the end is outside."""
    at = minute_of_day(time)
    whole = F.filter(F.try_element_at(hours, weekday), lambda r: r.rlike(r"^(?:[01]?\d|2[0-3]):[0-5]\d-(?:[01]?\d|2[0-3]):[0-5]\d$"))
    inside = lambda r: (minute_of_day(F.split_part(r, F.lit("-"), F.lit(1))) <= at) & (at < minute_of_day(F.split_part(r, F.lit("-"), F.lit(2))))
    return F.split_part(F.get(F.filter(whole, inside), F.lit(0)), F.lit("-"), F.lit(2))


def is_bare_midnight(start: Column, category: Column) -> Column:
    """Midnight sharp where the category doesn't begin then: a time that nobody gave."""
    return F.coalesce((F.hour(start) == 0) & (F.minute(start) == 0), F.lit(False)) & ~F.coalesce(F.lower(category).isin(*LATE_CATEGORIES), F.lit(False))


def is_all_day(flag: Column, start_text: Column) -> Column:
    """Flagged so, or a midnight that was written without a time."""
    return F.coalesce(flag, F.lit(False)) | F.coalesce(~start_text.contains("T") & start_text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))


def is_multi_day(flag: Column, start: Column, end: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(F.to_date(start) != F.to_date(end), F.lit(False))


def cron_due(expression: Column, now: Column) -> Column:
    """Whether five fields of a number, `*` or `*/n` fit the minute; weekdays count from 0 on Sunday. Lists and ranges count by their first number."""
    parts = F.split(expression, " ")
    due = F.size(parts) == 5
    for i, value in enumerate((F.minute(now), F.hour(now), F.dayofmonth(now), F.month(now), F.dayofweek(now) - 1)):
        field = F.get(parts, F.lit(i))
        step, number = F.regexp_extract(field, r"^\*/(\d+)", 1).try_cast("int"), F.regexp_extract(field, r"^\s*(\d+)", 1).try_cast("int")
        due = due & F.coalesce((field == "*") | F.when(field.startswith("*/"), F.try_mod(value, step) == 0).otherwise(number == value), F.lit(False))
    return F.coalesce(due, F.lit(False))


def payload_hash(title: Column, date: Column, location: Column, description: Column, url: Column) -> Column:
    """SHA-256 of the facts as ordered JSON, the description's first 500 characters; a missing fact has no key."""
    record = F.struct(title.alias("title"), date.alias("date"), location.alias("location"), F.substring(description, 1, 500).alias("description"), url.alias("detailUrl"))
    return F.sha2(F.to_json(record), 256)


def structured_address(venue: Column, street: Column, city: Column, postal: Column) -> Column:
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.when(filled(venue).isNotNull(), F.struct(venue.alias("venue"), filled(street).alias("street"), filled(city).alias("city"), filled(postal).alias("postal_code"), F.lit("Netherlands").alias("country")))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th; 11th to 13th."""
    tail = F.pmod(n, F.lit(100))
    last = F.when(tail.between(11, 13), 0).otherwise(F.pmod(n, F.lit(10)))
    return F.concat(n.cast("string"), F.when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th"))


def possessive(name: Column) -> Column:
    return F.concat(name, F.when(name.endswith("s"), "'").otherwise("'s"))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2_000_000))


def clean_input(text: Column) -> Column:
    """No angle brackets, trimmed, 1000 characters at most: the limit is the feature."""
    return F.substring(F.trim(F.regexp_replace(text, "[<>]", "")), 1, 1000)


def is_phone(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\+[1-9]\d{1,14}$"), F.lit(False))


def venue_of(name: Column) -> Column:
    """struct<key, name, city> of the registry: the same key, else the first that holds the name's or is held by it."""
    key = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^A-Za-z0-9_\s]", ""), r"\s+", "_")
    same = partly = None
    for known, title, city in VENUES:
        found = F.struct(F.lit(known).alias("key"), F.lit(title).alias("name"), F.lit(city).alias("city"))
        held = key.contains(known) | F.lit(known).contains(key)
        same = F.when(key == known, found) if same is None else same.when(key == known, found)
        partly = F.when(held, found) if partly is None else partly.when(held, found)
    return F.coalesce(same, partly)


def inferred_city(venue: Column) -> Column:
    """The word behind `stadion` or `stadium`, else the one before it, else the registry's city."""
    lower = F.lower(venue)
    word = F.coalesce(*[F.nullif(F.regexp_extract(lower, p, 1), F.lit("")) for p in (r"(?:stadion|stadium)\s+(\w+)", r"(\w+)\s+(?:stadion|stadium)")])
    return F.coalesce(capitalised(word), venue_of(venue)["city"])
