"""Unions by key, duplicates among indexed rows, and coordinates on pages."""

from pyspark.sql import functions as F

from larkspan.functions import curation
from larkspan.operators import changes


def test_keyed_union_keeps_positions_and_takes_the_last_value(spark):
    first = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("a", 3, 3), (None, 4, 4)], "id string, v long, place long")
    second = spark.createDataFrame([("c", 5, 1), ("b", None, 2), (None, 6, 3)], "id string, v long, place long")
    got = [tuple(r) for r in changes.keyed_union([first, second], "id", "place").orderBy("place").collect()]
    assert got == [("a", 3, 1), ("b", None, 2), (None, 6, 3), ("c", 5, 4)]
    assert changes.keyed_union([first.limit(0), second.limit(0)], "id", "place").count() == 0


def test_duplicates_among_indexed_rows(spark):
    known = spark.createDataFrame([(1, "h1", "indexed"), (2, "h2", "indexed"), (3, "h2", "indexed"), (4, "h3", "failed"), (5, None, "indexed")], "item_id long, content_hash string, stage string")
    items = spark.createDataFrame([(10, "h1", "extracting"), (11, "h1", "extracting"), (12, "h2", "extracting"), (13, "h3", "extracting"), (14, None, "extracting"), (1, "h1", "indexed")], "item_id long, content_hash string, stage string")
    got = {r.item_id: (r.stage, r.duplicate_of, r.last_failure_reason) for r in changes.marked_duplicates(items, known).collect()}
    copy = ("failed", 1, "Duplicate detected")
    assert got == {10: copy, 11: copy, 12: ("extracting", None, None), 13: ("extracting", None, None), 14: ("extracting", None, None), 1: ("indexed", None, None)}


def test_page_coordinates(spark):
    ld, pad = '<script type="application/ld+json">%s</script>', "<p>words of a page</p>" * 6
    pages = {
        ld % '{"@type":"Event","location":{"geo":{"lat":"52.5","lng":"4.5"}}}': (52.5, 4.5, "jsonld", 0.95),
        ld % '{"@type":"Place","geo":{"latitude":52.5,"longitude":4.5}}': (52.5, 4.5, "jsonld", 0.9),
        ld % '{"@type":"GeoCoordinates","latitude":52.5,"lon":4.5}': (52.5, 4.5, "jsonld", 0.9),
        ld % '{"@type":"Product","geo":{"latitude":52.5,"longitude":4.5}}': None,
        ld % '{"@type":"GeoCoordinates","latitude":0,"longitude":0}' + '<meta content="51.5" property="og:latitude"/><meta property="og:longitude" content="5"/>': (51.5, 5.0, "opengraph", 0.85),
        ld % '{"@type":"Event"}' + '<meta content="50.5;5.5" name="geo.position">': (50.5, 5.5, "meta", 0.85),
        '<meta name="ICBM" content="north, east">': None,
        '<iframe src="https://www.google.com/maps/embed?center=52.25,-4.5&x">': (52.25, -4.5, "embed", 0.85),
    }
    frame = spark.createDataFrame([(i, p + pad) for i, p in enumerate(pages)] + [(98, "short"), (99, None)], "k int, h string")
    got = {r.k: r.c and tuple(r.c) for r in frame.select("k", curation.page_coordinates(F.col("h")).alias("c")).collect()}
    assert got == {**dict(enumerate(pages.values())), 98: None, 99: None}
