"""Re-ranking over whole tables against the greedy rule read literally."""

import random

import pytest

from larkspan.operators import diversity

SCHEMA = "event_id long, category string, final_score double, other string"


def literal(rows, memory=2):
    """The rule as it is stated: each pick scans all that is left."""
    left = sorted(rows, key=lambda r: (-(r[2] or 0.0), r[0] is not None, r[0] or 0))
    last, out = [], []
    while left:
        best, best_score = 0, float("-inf")
        for i, (_, category, score) in enumerate(left):
            marked = score or 0.0
            if category in last:
                marked *= 1 - (len(last) - last.index(category)) / (memory + 1)
            if marked > best_score:
                best, best_score = i, marked
        event_id, category, score = left.pop(best)
        out.append((event_id, category, score or 0.0, best_score, len(out) + 1))
        last = [*last, category][-memory:] if memory else []
    return out


def picked(frame):
    return [(r.event_id, r.category, r.final_score, r.diverse_score, r.place) for r in frame.orderBy("place").collect()]


@pytest.mark.parametrize(("n", "memory", "held"), [(240, 2, 4_000_000), (240, 2, 40), (60, 1, 7), (60, 0, 9), (90, 3, 12)])
def test_equals_the_literal_rule(spark, n, memory, held):
    """Ties, a category with most of the rows, null categories, scores below 0, null scores, repeated rows; pages down to a row."""
    rng = random.Random(n + memory + held)
    rows = [(i, rng.choice(["a", "a", "a", "a", "b", "c", None]), rng.choice([round(rng.random(), 1), rng.random(), -0.5, None])) for i in range(n)]
    rows += [(7, "b", 0.5)] * 3
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    assert picked(diversity.diversified(frame, memory=memory, held_rows=held)) == literal(rows, memory)


def test_top_is_the_beginning(spark):
    rows = [(i, "ab"[i % 3 == 0], (i * 37 % 101) / 100) for i in range(100)]
    frame = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    assert picked(diversity.diversified(frame, top=9, held_rows=8)) == literal(rows)[:9]
    assert diversity.diversified(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_page_reads_its_ranges_only(spark):
    rows = [(i, "abcde"[i % 5], (i * 7919 % 10007) / 10007) for i in range(5000)]
    got = picked(diversity.diversified(spark.createDataFrame([(*r, None) for r in rows], SCHEMA), held_rows=5000))
    assert [r[4] for r in got] == list(range(1, 5001)) and len({r[0] for r in got}) == 5000


def test_queues_meet_by_heads():
    queues = {0: ([9.0, 8.0, 7.0], [1, 2, 3]), 1: ([6.0], [4]), 2: ([2.0, 1.0], [5, 6])}
    assert [(c, i) for c, i, _ in diversity.greedy(queues, [], 2, 10)] == [(0, 0), (1, 0), (0, 1), (0, 2), (2, 0), (2, 1)]
    assert [(c, i) for c, i, _ in diversity.greedy(queues, [0, 0], 2, 2)] == [(1, 0), (0, 0)]
