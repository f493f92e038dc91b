"""The vector index against the exact scan: recall, exactness by bounds, pruned files and split cells."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.operators import search, vector_index

SCHEMA = "event_id long, embedding array<float>, category string, piece string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    out = [(i, [float(x) for x in centres[i % 12] + 0.25 * rng.normal(size=16)], "ab"[i % 2]) for i in range(600)]
    out += [(1000 + i, [1.0] * 16, "copy") for i in range(300)]
    return out + [(2000, None, "a"), (2001, [0.0] * 16, "a"), (2002, [float("nan")] + [1.0] * 15, "a")]


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).drop("piece")


@pytest.fixture(scope="module")
def index(events, tmp_path_factory):
    return vector_index.build(events, str(tmp_path_factory.mktemp("index")) + "/i", cells=12, piece_rows=50)


def unit(rows):
    kept = [(i, np.array(v, np.float32).astype(float), c) for i, v, c in rows if v is not None and np.isfinite(v).all() and np.any(v)]
    return [(i, v / np.linalg.norm(v), c) for i, v, c in kept]


def test_every_row_with_a_direction_is_stored_once(index, rows):
    assert sorted(r.event_id for r in index.vectors.select("event_id").collect()) == sorted(i for i, *_ in unit(rows))
    assert index.cells.agg(F.sum("n")).first()[0] == len(unit(rows))


def test_a_hot_cell_is_stored_in_pieces(index):
    hot = index.vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("piece").alias("pieces")).orderBy(F.desc("n")).first()
    assert hot.n >= 300 and hot.pieces >= 5
    assert index.vectors.groupBy("cell", "piece").count().agg(F.max("count")).first()[0] < 120


@pytest.mark.parametrize("threshold", [0.95, 0.7, 0.0, -1.0])
def test_bounds_lose_nothing(index, events, rows, threshold):
    """Exact at any threshold without a number of probes, with and without a category."""
    query = [float(x) for x in rows[5][1]]
    for category in (None, "a"):
        sound = events.filter(vector_index._usable(F.col("embedding")))
        want = [(r.event_id, round(r.similarity, 9)) for r in search.match(sound, query, threshold, 25, category).collect()]
        assert [(r.event_id, round(r.similarity, 9)) for r in vector_index.match(index, query, threshold, 25, category).collect()] == want
    assert len(vector_index.cells_for(index, query, 0.95)) < 6 and len(vector_index.cells_for(index, query, -1.0)) == index.cells.count()


def test_only_chosen_cells_are_read(index, rows):
    query = [float(x) for x in rows[5][1]]
    plan = vector_index.match(index, query, 0.9, 10)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)
    assert len(vector_index.cells_for(index, query, 0.9)) < index.cells.count() / 2


def test_find_similar_leaves_itself_out(index, rows):
    got = [r.event_id for r in vector_index.find_similar(index, 5, 0.7, 5).collect()]
    by = {i: v for i, v, _ in unit(rows)}
    assert got == sorted((i for i in by if i != 5 and by[i] @ by[5] > 0.7), key=lambda i: (-by[i] @ by[5], i))[:5]
    with pytest.raises(ValueError):
        vector_index.find_similar(index, 2000)


def test_recall_of_many_queries(index, spark, rows):
    queries = index.vectors.select(F.col("event_id").alias("query_id"), "embedding")
    asked = queries.filter("query_id % 20 = 0")
    exact = vector_index.search_many(index, asked)
    by = unit(rows)
    names, matrix = np.array([i for i, *_ in by]), np.array([v for _, v, _ in by])
    want = {}
    for i, v, _ in by:
        if i % 20 == 0:
            scores = np.round(matrix @ v, 9)
            scores[names == i] = -9
            want[i] = [int(names[j]) for j in np.lexsort((names, -scores))[:10]]
    got = {}
    for r in exact.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.event_id)
    near = lambda a, b: len(set(a) & set(b))  # noqa: E731  copies tie up to rounding
    assert set(got) == set(want) and all(near(got[q], want[q]) == 10 or q >= 1000 for q in want)
    probes = vector_index.tuned_probes(index, queries.filter("query_id % 20 = 1"))
    assert 1 <= probes < 12
    assert vector_index.recall(vector_index.search_many(index, asked, probes=probes), exact).first().recall >= 0.9


def test_nothing_to_index(spark, tmp_path):
    empty = vector_index.build(spark.createDataFrame([(1, None, "a", "x")], SCHEMA), str(tmp_path / "none"))
    assert vector_index.match(empty, [1.0] * 4).count() == 0
    assert vector_index.search_many(empty, spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")).count() == 0
    assert vector_index.tuned_probes(empty, spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")) == 1
    one = vector_index.build(spark.createDataFrame([(random.randrange(9), [2.0, 0.0], "a", "x")], SCHEMA), str(tmp_path / "one"))
    assert vector_index.match(one, [1.0, 0.0]).count() == 1
