"""Structured data in pages: odd notations, nesting, order, and the waterfall over them."""

import pytest
from pyspark.sql import functions as F

from larkspan.sources import html, structured

LD = '<script type="application/ld+json">%s</script>'
NEXT = '<script id="__NEXT_DATA__" type="application/json">%s</script>'


def read(spark, reader, pages):
    frame = spark.createDataFrame(list(enumerate(pages)), "k int, h string")
    got = {r.k: r.c for r in frame.select("k", reader(F.col("h")).alias("c")).collect()}
    return [[tuple(c) for c in got[i] or []] for i in range(len(pages))]


def test_json_ld(spark):
    event = '{"@type":"MusicEvent","name":"A","startDate":"2026-01-01","location":{"@type":"Place","name":"Hall"},"image":[{"url":"i.jpg"}],"url":"u"}'
    pages = [
        LD % event,
        LD % ('{"@graph":[{"@type":"WebPage","name":"no"},' + event + "],}"),
        LD % ("[" + event + ',{"@type":["Thing","Festival"],"name":["B","b"],"description":{"@value":"d"}}]'),
        LD % ('{"@type":"ItemList","itemListElement":[{"@type":"ListItem","item":' + event + '},{"@type":"Event","name":"C"}]}'),
        LD % event.replace('"', "&quot;"),
        LD % ("/* note */ " + event[:-1] + ",\n};"),
        LD % '{"@type":"Event"}' + LD % "not json" + LD % '{"@type":"Eventful","name":"x"}' + LD % '{"@graph":[{"@graph":[[' + event + "]]}]}",
        LD % '"Event"' + LD % "[1, null, [2]]",
        "<p>" + event,
        None,
    ]
    a = ("A", "2026-01-01", "Hall", None, "u", "i.jpg")
    got = read(spark, structured.json_ld, pages)
    assert got[0] == got[1] == got[4] == got[5] == [a]
    assert got[2] == [a, ("B", None, None, "d", None, None)]
    assert sorted(got[3]) == [a, ("C", None, None, None, None, None)]
    assert got[6] == [] and got[7] == got[8] == got[9] == []
    assert read(spark, structured.json_ld, [LD % ('{"@graph":[{"@graph":[' + event + "]}]}")]) == [[a]]


def test_hydration(spark):
    card = '{"title":"T","start":"d","venue":{"name":"V"},"more":{"title":"inner","date":"x"}}'
    deep = lambda n: '{"a":' * n + card + "}" * n
    pages = [NEXT % deep(3), "<script>window.__NUXT__ = " + deep(2) + ";</script>", NEXT % ("[" + card + "," + card + "]"), NEXT % deep(9), NEXT % deep(11), NEXT % '{"title":"no date"}', NEXT % "{", None]
    t = ("T", "d", "V", None, None, None)
    assert read(spark, structured.hydration, pages) == [[t], [t], [t, t], [t], [], [], [], []]


def test_microdata(spark):
    pages = [
        '<div itemscope itemtype="http://schema.org/Event"><h1 itemprop="name">M &amp; N</h1><time itemprop="startDate" datetime="2026">x</time></div>',
        '<div itemtype="x" itemscope></div><li itemscope itemtype="https://schema.org/MusicEvent"><a itemprop="url" href="/u"><b itemprop="name"> One </b></a><meta itemprop="startDate" content="d"><div itemprop="location" itemscope itemtype="https://schema.org/Place"><span itemprop="name">Hall</span></div><img itemprop="image" src="i"></li>'
        '<li itemscope itemtype="https://schema.org/Festival"><b itemprop="name">Two</b></li><li itemscope itemtype="https://schema.org/Event"><i>no name</i></li>',
        '<div itemscope itemtype="https://schema.org/Place"><b itemprop="name">no</b></div>',
        None,
    ]
    assert read(spark, structured.microdata, pages) == [[("M & N", "2026", None, None, None, None)], [("One", "d", "Hall", None, "/u", "i"), ("Two", None, None, None, None, None)], [], []]


def test_feed(spark):
    pages = [
        "<rss><channel><item><title><![CDATA[F]]></title><link>u</link><pubDate>p</pubDate></item><item><title> </title></item></channel></rss>",
        '<feed><entry><title>E &amp; e</title><link rel="x" href="v"/><updated>t</updated><summary>s</summary></entry></feed>',
        "<rss><item><title></title></item></rss><feed><entry><title>G</title></entry></feed>",
        "<p><item><title>no feed</title></item>",
        None,
    ]
    assert read(spark, structured.feed, pages) == [[("F", "p", None, None, "u", None)], [("E & e", "t", None, "s", "v", None)], [("G", None, None, None, None, None)], [], []]


@pytest.mark.parametrize("preferred", [None, "dom", "feed"])
def test_waterfall(spark, preferred):
    ld, dom = LD % '{"@type":"Event","name":"L"}', '<li class="event"><h2>D</h2></li>'
    pages = [ld + dom, dom, "<p>", None, "<rss><item><title>R</title></item></rss>" + dom]
    frame = spark.createDataFrame([(i, p, "x") for i, p in enumerate(pages)], "k int, h string, strategy string")
    got = {r.k: (r.strategy, [c.title for c in r.cards], [(t.strategy, t.found) for t in r.trace]) for r in html.waterfall(frame, "k", "h", preferred=preferred).collect()}
    order = [preferred, *[s for s in html.STRATEGIES if s != preferred]] if preferred else list(html.STRATEGIES)
    holds = {0: {"json_ld": ["L"], "dom": ["D"]}, 1: {"dom": ["D"]}, 2: {}, 4: {"feed": ["R"], "dom": ["D"]}}
    for k, has in holds.items():
        won = next((s for s in order if s in has), None)
        seen = order[: order.index(won) + 1] if won else order
        assert got[k] == (won, has.get(won, []), [(s, len(has.get(s, []))) for s in seen])
    assert got[3] == (None, [], [])


def test_structured_data_needs_no_python(spark):
    frame = spark.createDataFrame([(1, "x")], "k int, h string")
    plan = html.waterfall(frame, "k", "h", order=("hydration", "json_ld", "microdata", "feed"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
