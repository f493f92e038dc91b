"""Scalar rules at their boundaries."""

import datetime

import pytest
from pyspark.sql import functions as F

from larkspan.functions import classify, dates, geo, scoring, text, vectors


def values(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_score_ladders(spark):
    hours = [(h,) for h in (-1.0, 0.0, 6.0, 6.1, 24.0, 24.1, 72.0, 72.1)]
    assert values(spark, hours, "h double", scoring.urgency_boost(F.col("h"))) == [0.1, 1.2, 1.2, 1.15, 1.15, 1.1, 1.1, 1.0]
    people = [(n,) for n in (0, 9, 10, 20, 50, 100)]
    assert values(spark, people, "n int", scoring.trending_boost(F.col("n"))) == [1.0, 1.0, 1.05, 1.1, 1.15, 1.2]
    assert values(spark, people[:1] + [(999,), (10**6,)], "n int", scoring.social_score(F.col("n"))) == [0.2, pytest.approx(1.0), 1.0]
    assert values(spark, [(None,), (0.1,), (12.5,), (1e6,)], "d double", scoring.distance_score(F.col("d"), 25)) == [0.5, 1.0, 0.5, 0.1]
    assert values(spark, [(-0.1,), (0.5,), (1.0,), (100.0,)], "d double", scoring.time_score(F.col("d"))) == [0.0, 1.0, pytest.approx(0.8669, abs=1e-4), 0.1]


def test_health(spark):
    rows = [(None, False, True), (15, True, False), (95, False, True)]
    got = values(spark, rows, "h int, failed boolean, complete boolean", scoring.health_after(F.col("h"), F.col("failed"), F.col("complete"), F.lit(True), F.lit(True)))
    assert got == [80, 0, 100]


DATES = [
    ("vandaag", "2026-01-17"), ("morgen", "2026-01-18"), ("overmorgen", "2026-01-19"), ("2026-05-15", "2026-05-15"), ("15-05-2026", "2026-05-15"), ("15/05/2026", "2026-05-15"),
    ("12 okt", "2026-10-12"), ("za 18 mei", "2026-05-18"), ("invalid date", None), ("", None), (None, None),
]


@pytest.mark.parametrize("parse", [dates.iso_date, dates.rolling_date])
def test_dates(spark, parse):
    got = values(spark, [(d,) for d, _ in DATES], "d string", parse(F.col("d"), F.lit("2026-01-17").cast("date")))
    assert got == [want for _, want in DATES]


def test_date_rules_differ(spark):
    rows = [("12 jan",), ("2035-01-01",), ("Mon, 13 Oct 2025 14:04:25 +0000",), ("1/2/99",)]
    today = F.lit("2026-01-17").cast("date")
    assert values(spark, rows, "d string", dates.iso_date(F.col("d"), today)) == ["2026-01-12", None, "2025-10-13", None]
    assert values(spark, rows, "d string", dates.rolling_date(F.col("d"), today)) == ["2027-01-12", "2035-01-01", None, "1999-02-01"]


def test_times(spark):
    rows = [("20:00",), ("8.30",), ("20h00",), ("8:30 PM",), ("doors: 19:00, start: 20:00",), ("20 uur",), ("tbd",), ("25:00",), (None,)]
    assert values(spark, rows, "t string", dates.clock_time(F.col("t"))) == ["20:00", "08:30", "20:00", "20:30", "20:00", "20:00", None, None, None]
    rows = [("2h 30min",), ("1 uur 45 minuten",), ("90 min",), ("120",), ("x",)]
    assert values(spark, rows, "t string", dates.minutes_of(F.col("t"))) == [150, 105, 90, 120, None]


def test_late_end(spark):
    rows = [(datetime.datetime(2026, 5, 1, 23), "02:00"), (datetime.datetime(2026, 5, 1, 20), "22:00")]
    got = values(spark, rows, "s timestamp, e string", F.date_format(dates.late_end(F.col("s"), F.col("e")), "dd HH:mm"))
    assert got == ["02 02:00", "01 22:00"]


def test_opening_hours(spark):
    rows = [({"monday": ["09:00-12:00", "22:00-02:00"]}, "monday", t) for t in ("09:00", "12:00", "23:00")]
    frame = spark.createDataFrame(rows, "h map<string,array<string>>, d string, t string")
    got = frame.select(dates.open_at(F.col("h"), F.col("d"), F.col("t")), dates.next_opening(F.col("h"), F.lit("sunday"))).collect()
    assert [tuple(r) for r in got] == [(True, "monday 09:00"), (False, "monday 09:00"), (False, "monday 09:00")]


def test_prices(spark):
    rows = [("€€",), ("15",), ("tot 40,00",), ("12 - 100",), ("101",), ("gratis",), (None,)]
    assert values(spark, rows, "p string", classify.price_range(F.col("p"))) == ["€€", "€", "€€", "€€€", "€€€€", "gratis", ""]


def test_categories(spark):
    rows = [("Techno in the club", None), ("wireless poëzie", None), ("een gewone dag", None), ("x", "https://a.example/museum/1"), ("kinderen spelen", None), ("clubhuis", None)]
    assert values(spark, rows, "t string, u string", classify.category(F.col("t"), F.col("u"))) == ["NIGHTLIFE", "CULTURE", "COMMUNITY", "CULTURE", "FAMILY", "COMMUNITY"]


def test_language(spark):
    dutch = "Het programma van de voorstelling begint om acht uur en de zaal is open voor alle kinderen en hun ouders"
    english = "The doors open at eight and the show is free for all of you who want to be there with their friends"
    assert values(spark, [(dutch,), (english,), ("kort",), (None,)], "t string", classify.language_profile(F.col("t"))["language"]) == ["NL", "EN", "Other", "Other"]


def test_text(spark):
    assert values(spark, [("Café  Night!",)], "t string", text.normal_title(F.col("t"))) == ["caf night"]
    assert values(spark, [("Café  Ñandú!",)], "t string", text.fuzzy(F.col("t"))) == ["cafe nandu"]
    assert values(spark, [("abc",)], "t string", text.rolling_hash36(F.col("t"))) == [format_base36(96354)]
    rows = [("a", "a"), ("", "x"), ("kitten", "sitting")]
    assert values(spark, rows, "a string, b string", text.similarity(F.col("a"), F.col("b"))) == [1.0, 0.0, pytest.approx(4 / 7)]
    urls = [("/x",), ("y",), ("//z.example/q",), ("https://o.example",)]
    assert values(spark, urls, "h string", text.resolve_url(F.col("h"), F.lit("https://a.example/b/c?d"))) == ["https://a.example/x", "https://a.example/b/y", "https://z.example/q", "https://o.example"]
    assert values(spark, [("https://a.example/?utm_source=1&id=2&gclid=3",)], "u string", text.without_tracking(F.col("u"))) == ["https://a.example/?id=2"]


def format_base36(n):
    digits = ""
    while n:
        n, r = divmod(n, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
    return digits


def test_geo(spark):
    rows = [(52.37, 4.90, 51.9225, 4.4792)]
    assert values(spark, rows, "a double, b double, c double, d double", geo.haversine_km(*map(F.col, "abcd"))) == [pytest.approx(57.4, abs=0.5)]
    points = [("POINT(4.9 52.37)",), ('{"type":"Point","coordinates":[4.9,52.37]}',), ("x",), (None,)]
    got = values(spark, points, "p string", geo.parse_point(F.col("p")))
    assert [(p.lat, p.lng) if p else None for p in got] == [(52.37, 4.9), (52.37, 4.9), None, None]
    import struct

    raw = (b"\x01" + struct.pack("<II", 0x20000001, 4326) + struct.pack("<dd", 4.9, -52.37)).hex()
    got = values(spark, [(raw,)], "p string", geo.parse_ewkb(F.col("p")))
    assert (got[0].lat, got[0].lng) == (-52.37, 4.9)
    assert values(spark, [(0.05,), (0.42,), (3.14159,)], "k double", geo.distance_label(F.col("k"))) == ["right here", "400m away", "3.1km away"]


def test_cosine(spark):
    rows = [([1.0, 0.0],), ([0.0, 0.0],), ([1.0, 1.0],)]
    assert values(spark, rows, "v array<double>", vectors.cosine_to(F.col("v"), [1.0, 0.0])) == [1.0, None, pytest.approx(0.7071, abs=1e-4)]
