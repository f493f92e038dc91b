"""Fuzzy duplicates by the segment index against brute force."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from larkspan.operators import dedup

SCHEMA = "event_id long, title string, venue_name string, event_date timestamp, bucket string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def alike(a, b):
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    return 0.0 if not a or not b else (max(len(a), len(b)) - edits(a, b)) / float(max(len(a), len(b)))


def normal(text):
    return None if text is None else re.sub(r"\s+", " ", re.sub(r"[^A-Za-z0-9_\s]", "", text.lower())).strip()


def brute(new, known, hours=2, least=0.8):
    out = {}
    for i, title, venue, at in new:
        best = None
        for j, title2, venue2, at2 in known:
            if i == j or None in (title, title2, at, at2) or abs((at - at2).total_seconds()) > hours * 3600:
                continue
            sure = min(1.0, alike(normal(title), normal(title2)) + (0.1 if (alike(normal(venue), normal(venue2)) or 0) > 0.8 else 0.0))
            if sure >= least and (best is None or (-sure, j) < best):
                best = (-sure, j)
        if best:
            out.setdefault(i, []).append((best[1], round(-best[0], 9)))
    return {i: sorted(v) for i, v in out.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    start = datetime.datetime(2026, 1, 1)
    words = ["Weekly Jazz Night", "Harbour Walk", "Open Stage!", "a", "", "ab", "abc", "Chess Evening at the Old Town Hall", "über uns"]

    def changed(title):
        chars = list(title)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(chars) + 1)
            what = rng.randrange(3)
            chars[at : at + (what > 0)] = rng.choice("abx ") * (what != 1)
        return "".join(chars)

    out = [(i, changed(rng.choice(words)), rng.choice(["Hall", "Hall 1", "Halle 12", "Town Hall", None]), start + datetime.timedelta(minutes=rng.choice([0, 1, 119, 120, 121, 240, 241, 500]))) for i in range(260)]
    out += [(300 + i, "Hot Title", "Same Place", start) for i in range(80)]
    return out + [(400, None, "Hall", start), (401, "Open Stage", None, None), (402, "Open Stage", "", start), (402, "Open Stage", "", start), (-5, "Weekly Jazz Nigth", "Hall", datetime.datetime(1969, 12, 31, 23, 0))]


@pytest.mark.parametrize("few", [0, 6, 400])
def test_equals_brute_force(spark, rows, few):
    """All keys by the segment index, some by it, and none."""
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    for part in ("event_id % 3 = 0", "event_id % 3 <> 5"):
        new, known = frame.filter(part), frame.filter("event_id % 2 = 0")
        got = {}
        for r in dedup.fuzzy_duplicates(new, known, few=few).collect():
            got.setdefault(r.new_id, []).append((r.known_id, round(r.confidence, 9)))
        pick = lambda f: [r for r in rows if f(r[0])]
        want = brute(pick(lambda i: i % 3 == 0 if part.endswith("= 0") else True), pick(lambda i: i % 2 == 0))
        assert {i: sorted(v) for i, v in got.items()} == want and len(want) > 60
    nothing = spark.createDataFrame([], SCHEMA)
    assert dedup.fuzzy_duplicates(nothing, frame).count() == dedup.fuzzy_duplicates(frame, nothing).count() == 0


@pytest.mark.parametrize("least", [0.7, 0.9, 0.5])
def test_segments_lose_no_pair(spark, least):
    rng = random.Random(int(least * 10))
    titles = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(14))) for _ in range(150)})
    frame = spark.createDataFrame([(1, t) for t in titles], "k int, title string")
    got = {(r.new_title, r.known_title) for r in dedup.similar_titles(frame, frame, ["k"], least, few=0).collect()}
    assert got == {(a, b) for a in titles for b in titles if alike(a, b) >= least - 1e-9}


def test_copies_do_not_multiply(spark):
    """A third of all rows are one event: what the index joins doesn't grow with the copies."""
    at = datetime.datetime(2026, 1, 1)
    frame = spark.createDataFrame([(i, "Hot Title", "Place", at, None) for i in range(4000)], SCHEMA)
    got = dedup.fuzzy_duplicates(frame, frame)
    assert got.count() == 4000
    assert got.filter("new_id = 0").first().known_id == 1 and got.filter("new_id > 0").agg(F.max("known_id")).first()[0] == 0
