"""Clusters of people, common slots and overlaps against brute force, with hot groups, long events and the edges of the globe."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from larkspan.operators import dedup, groups

PEOPLE = "g long, user_id long, lat double, lng double, row string"


def km_between(a, b):
    dlat, dlng = math.radians(b[0] - a[0]) / 2, math.radians(b[1] - a[1]) / 2
    x = math.sin(dlat) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(dlng) ** 2
    return 12742.0 * math.atan2(math.sqrt(x), math.sqrt(max(0.0, 1 - x)))


@pytest.fixture(scope="module")
def people():
    """Groups in a town, over the date line, around a pole, on one spot, and alone; some without a position."""
    rng, out = random.Random(6), []
    spots = {1: (52.3, 4.8, 0.35, 0.6), 2: (-17.0, 180.0, 0.3, 0.3), 3: (89.95, 0.0, 0.1, 360.0), 4: (0.0, 0.0, 0.4, 0.4), 5: (60.0, -179.9, 0.2, 0.4)}
    n = 0
    for g, (lat, lng, high, wide) in spots.items():
        for _ in range(110):
            east = lng + rng.uniform(-wide, wide)
            out.append((g, n, min(90.0, lat + rng.uniform(-high, high)), (east + 180) % 360 - 180))
            n += 1
    out += [(6, 1000 + i, 10.0, 20.0) for i in range(200)] + [(7, 2000, 1.0, 1.0), (7, 2001, 2.0, 2.0), (8, 2002, None, 1.0), (8, 2003, 1.0, None), (None, 2004, 1.0, 1.0)]
    return out


def brute_pairs(people, km):
    placed = [p for p in people if None not in p]
    return {(a[0], a[1], b[1]) for i, a in enumerate(placed) for b in placed[i + 1 :] if a[0] == b[0] and km_between(a[2:], b[2:]) <= km}


@pytest.mark.parametrize("km", [3.0, 7.5, 40.0])
def test_pairs_and_clusters(spark, people, km):
    frame = spark.createDataFrame([(*p, "x") for p in people], PEOPLE).repartition(3)
    want = brute_pairs(people, km)
    assert {tuple(r) for r in groups.close_pairs(frame, ["g"], km).collect()} == want
    parent = {p[1]: p[1] for p in people}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, a, b in want:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    sizes = collections.defaultdict(list)
    for p in people:
        if None not in p:
            sizes[p[0], find(p[1])].append(p)
    best = {}
    for (g, root), members in sizes.items():
        if len(members) > 1:
            best[g] = max(best.get(g, (0, 0, ())), (len(members), -root, tuple(members)), key=lambda x: x[:2])
    got = {r.g: (r.members, -r.cluster, r.hub_lat, r.hub_lng) for r in groups.majority_clusters(frame, ["g"], km).collect()}
    assert {g: v[:2] for g, v in got.items()} == {g: v[:2] for g, v in best.items()}
    for g, (n, _, lat, lng) in got.items():
        assert abs(lat - sum(m[2] for m in best[g][2]) / n) < 1e-9 and abs(lng - sum(m[3] for m in best[g][2]) / n) < 1e-6


def test_a_crowd_costs_cells_and_not_pairs(spark):
    crowd = spark.range(20_000).select(F.lit(1).alias("g"), F.col("id").alias("user_id"), (52 + F.rand(1) / 100).alias("lat"), (4 + F.rand(2) / 100).alias("lng"), F.lit("x").alias("row"))
    cells, pairs = groups.linked_cells(crowd, ["g"], 1.0)
    assert cells.count() < 20 and pairs.count() < 200
    assert groups.majority_clusters(crowd, ["g"], 1.0).first().members == 20_000


def brute_slots(blocks, totals, start, end, minutes, most):
    out = []
    for g in {b[0] for b in blocks}:
        inside = [b for b in blocks if b[0] == g and b[2] < end and b[3] > start and b[2] < b[3]]
        points = sorted({p for b in inside for p in b[2:]})
        merged = []
        for p, q in zip(points, points[1:]):
            users = frozenset(b[1] for b in inside if b[2] <= p and b[3] >= q)
            if users and merged and merged[-1][1] == p and merged[-1][2] == users:
                merged[-1][1] = q
            elif users:
                merged.append([p, q, users])
        kept = [(len(u) != totals[g], -len(u), p, q) for p, q, u in merged if q - p >= minutes * 60]
        out += [(g, i, p, q, -n, not part) for i, (part, n, p, q) in enumerate(sorted(kept)[:most], 1)]
    return sorted(out)


def test_common_slots(spark):
    """Users with blocks that overlap, touch and repeat; one leaves as another comes; a group without blocks."""
    rng = random.Random(9)
    blocks = []
    for _ in range(400):
        start = rng.randrange(40) * 1800
        blocks.append((rng.randrange(4), rng.randrange(5), start, start + rng.randrange(-1, 9) * 1800))
    blocks += [(9, 1, 0, 7200), (9, 2, 7200, 14400), (9, 1, 7200, 7200), (9, 3, -(10**9), 10**9)]
    totals = {g: len({b[1] for b in blocks if b[0] == g}) for g in {b[0] for b in blocks}}
    frame = spark.createDataFrame(blocks, "g long, user_id long, start long, `end` long").repartition(3)
    known = spark.createDataFrame(list(totals.items()) + [(77, 3)], "g long, total long")
    for minutes, most in ((30, 50), (60, 5)):
        got = sorted(tuple(r) for r in groups.common_slots(frame, ["g"], known, F.lit(1800), F.lit(36 * 1800), minutes, most).collect())
        assert got == brute_slots(blocks, totals, 1800, 36 * 1800, minutes, most)


EVENTS = "who string, event_id long, start long, `end` long, part string"


@pytest.mark.parametrize("parts", [1, 6, 30])
def test_overlaps(spark, parts):
    """A key with half of all events, an event of ten years, open ends, no length, the same start, repeated ids and nulls."""
    rng, rows = random.Random(4), []
    for i in range(300):
        start = rng.randrange(60) * 3600
        rows.append(("hot" if i % 2 else rng.choice("abc"), i, start, rng.choice([None, start + rng.randrange(-1, 9) * 3600])))
    rows += [("hot", 1000, -(10**8), 3 * 10**8), ("a", 1001, 7200, 7200), ("a", 1002, 7200, 7200), (None, 1003, 0, 10**6), (None, 1004, 0, 10**6), ("b", 1005, None, 10**6)]
    got = sorted(tuple(r) for r in dedup.overlaps(spark.createDataFrame([(*r, "x") for r in rows], EVENTS).repartition(3), "who", parts=parts).collect())
    held = [(w, i, s, s + 7200 if e is None else e) for w, i, s, e in rows if w is not None and s is not None]
    want = sorted((a[0], min(a[1], b[1]), max(a[1], b[1])) for n, a in enumerate(held) for b in held[n + 1 :] if a[0] == b[0] and a[2] < b[3] and b[2] < a[3])
    assert got == want and len(want) > 1000
    assert dedup.overlaps(spark.createDataFrame([], EVENTS), "who").count() == 0
