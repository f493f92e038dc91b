"""Queries of page rules, reports and a profile's lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions import classify, curation, scoring, text
from larkspan.operators import changes
from larkspan.plans import views as V
from larkspan.plans.samples import dealt, dealt_sql, joined, quoted
from larkspan.session import table
from larkspan.sources import html

_SNIPPETS = ["aanvang: 20.30", "vanaf 7:05 pm", "19h15 uur", "from 12:00 am", "doors open at 18:45", "20:00 - 22:00", "9.30", "om 25:00 of 8:15", "no time", "Start: om 21:10"]
_TIMES = ["20:30", "19:05", "19:15", "00:00", "18:45", "20:00", "09:30", None, None, "21:10"]


def page_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", curation.written_time(dealt("page_id", _SNIPPETS)).alias("time"), text.strip_tags(F.concat(F.lit("<p class='a'>"), dealt("page_id", _SNIPPETS), F.lit("</p>\n<b>x</b>"))).alias("plain"))


#: A page with an impossible hour has no time by the pattern that fits it first, and the last pattern sees the same hour.
PAGE_TIMES = f"SELECT page_id, {dealt_sql('page_id', _TIMES)} AS time, {dealt_sql('page_id', _SNIPPETS)} || ' x' AS plain FROM pages"


def likely_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    host = dealt("page_id", ["www.eventbrite.nl", "vvv.example", "m.facebook.com", "nl.wikipedia.org", "a.example"])
    snippet = dealt("page_id", ["zie 12 mei", "Agenda", "news", "op 1/2/2026"], 3)
    return p.select(
        "page_id", curation.is_event_url(F.col("url"), snippet).alias("event_like"), curation.is_noise_domain(host).alias("noise"), text.source_tier(host).alias("tier"),
        curation.is_tracking_url(F.concat(F.lit("https://"), host, dealt("page_id", ["/tr?id=1", "/Pixel.gif", "/a.png"], 2))).alias("tracking"), curation.is_listing_page(F.col("url")).alias("listing"),
    )


_PATH = "coalesce(nullif(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), ''), '/')"
_PARTS = f"len(list_filter(string_split({_PATH}, '/'), lambda x: x <> ''))"
LIKELY = f"""SELECT page_id, regexp_matches(lower(url), {quoted(curation.EVENT_SIGNS)}) OR page_id // 3 % 4 <> 2 AS event_like, page_id % 5 IN (2, 3) AS noise,
  CASE page_id % 5 WHEN 0 THEN 'tier_1_metropolis' WHEN 1 THEN 'tier_2_regional' ELSE {quoted('tier_3_hyperlocal')} END AS tier, page_id // 2 % 3 = 1 OR (page_id // 2 % 3 = 0 AND page_id % 5 = 2) AS tracking,
  regexp_matches({_PATH}, {quoted(curation.LISTING_PATH)}) OR regexp_matches({_PATH}, {quoted(curation.OTHER_PATH)}) OR regexp_matches({_PATH}, '/0*[0-9]{{1,4}}/?$')
    OR ({_PARTS} <= 2 AND NOT contains({_PATH}, '-20') AND NOT regexp_matches({_PATH}, '[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}') AND (NOT regexp_matches({_PATH}, {quoted(curation.EVENT_PATH)}) OR {_PARTS} < 2)) AS listing FROM pages"""

_BROKEN = ['{"a":1}', "{'a': 'b',}", "{a: 1, b_2: [1,2,],}", "{a: }", "[1, 2", "{\"t\":\n\"x\"}", "{k:\t'v'}"]
_REPAIRED = ['{"a":1}', '{"a": "b"}', '{"a": 1,"b_2": [1,2]}', None, None, "{\"t\":\n\"x\"}", '{"k":"v"}']


def repaired_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", curation.repaired_json(dealt("page_id", _BROKEN)).alias("json"))


JSON = f"SELECT page_id, {dealt_sql('page_id', _REPAIRED)} AS json FROM pages"

_CATEGORIES = ["MUSIC", "FOOD", "CULTURE", "CIVIC", "NONE"]
_ABOUT = ["Jazz concert met DJ", "Wine and beer lunch", "art film in het theater", "buurt en gemeente", ""]


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"))
    strict = scoring.social_five_strict(dealt("event_id", ["20:00", "8 pm", None], 2), F.lit("Hall"), dealt("event_id", [None, "", "Street"], 3), dealt("event_id", ["Zwolle", None], 5), dealt("event_id", [None, "22:00", ""], 7), dealt("event_id", [None, 0, 90], 11), dealt("event_id", ["NL", "FR"], 13), dealt("event_id", ["high", None], 17))
    return e.select("event_id", F.array_join(curation.tags_in(dealt("event_id", _ABOUT), dealt("event_id", _CATEGORIES, 5)), ",").alias("tags"), strict.alias("social_five"))


def _tags_sql() -> str:
    cells = [[",".join(t for t in curation.TAGS.get(c, "").split() if t in a.lower()) for a in _ABOUT] for c in _CATEGORIES]
    return "[" + ", ".join("[" + ", ".join(map(quoted, row)) + "]" for row in cells) + "][event_id // 5 % 5 + 1][event_id % 5 + 1]"


TAGGED = f"""SELECT o_orderkey AS event_id, {_tags_sql().replace('event_id', 'o_orderkey')} AS tags, ((o_orderkey // 2 % 3 = 0)::INT + (o_orderkey // 3 % 3 = 2 OR o_orderkey // 5 % 2 = 0)::INT + (o_orderkey // 7 % 3 = 1 OR o_orderkey // 11 % 3 = 2)::INT
  + (o_orderkey // 13 % 2 = 0)::INT + (o_orderkey // 17 % 2 = 0)::INT)::INT AS social_five FROM orders"""


def latest_commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each profile's three latest commitments with their events, and how many people go."""
    a = V.attendees(spark, sf_dir)
    e = V.events(spark, sf_dir).select("event_id", "title", "venue_name")
    counts = a.groupBy("event_id").agg(F.count(F.lit(1)).alias("attendee_count"))
    newest = Window.partitionBy("profile_id").orderBy(F.desc("joined_at"), "event_id", "place")
    going = a.filter("status = 'going'").withColumn("rank", F.row_number().over(newest)).filter("rank <= 3").select("profile_id", "rank", "event_id")
    return going.join(e, "event_id").join(counts, "event_id")


LATEST = f"""WITH {V.EVENTS},{V.ATTENDEES}, r AS (SELECT profile_id, event_id, (row_number() OVER (PARTITION BY profile_id ORDER BY joined_at DESC, event_id, place))::INT AS rank FROM att WHERE status = 'going'), n AS (SELECT event_id, count(*) AS attendee_count FROM att GROUP BY 1)
SELECT profile_id, rank, event_id, title, venue_name, attendee_count FROM r JOIN ev USING (event_id) JOIN n USING (event_id) WHERE rank <= 3"""


def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarked events of each profile after some were taken back, with the number of attendees; an event that has gone is left out."""
    b = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("profile_id"), (F.col("l_orderkey") + F.col("l_partkey") % 3).alias("event_id")).distinct()
    kept = changes.deleted(b, b.filter("(profile_id + event_id) % 4 = 0"), ["profile_id", "event_id"])
    counts = V.attendees(spark, sf_dir).groupBy("event_id").agg(F.count(F.lit(1)).alias("attendee_count"))
    return kept.join(V.events(spark, sf_dir).select("event_id", "title"), "event_id").join(counts, "event_id", "left").withColumn("attendee_count", F.coalesce("attendee_count", F.lit(0)))


BOOKMARKS = f"""WITH {V.EVENTS}, b AS (SELECT DISTINCT l_suppkey AS profile_id, l_orderkey + l_partkey % 3 AS event_id FROM lineitem), n AS (SELECT l_orderkey AS event_id, count(*) AS attendee_count FROM lineitem GROUP BY 1)
SELECT profile_id, event_id, title, coalesce(attendee_count, 0) AS attendee_count FROM b JOIN ev USING (event_id) LEFT JOIN n USING (event_id) WHERE (profile_id + event_id) % 4 <> 0"""


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, first and last times and the mean of attempts by stage, and the shares of all items by condition."""
    q = V.queue(spark, sf_dir)
    by = q.groupBy("stage").agg(F.count(F.lit(1)).alias("items"), F.min("ats").alias("oldest"), F.max("ats").alias("last_updated"), F.round(F.avg(F.col("k") % 4), 1).alias("mean_attempts"))
    whole = q.agg(F.lit("all").alias("stage"), F.count(F.lit(1)).alias("items"), F.min(F.when(F.col("failed"), F.col("ats"))).alias("oldest"), F.count_if(F.col("failed")).alias("last_updated"), F.round(F.count_if(F.col("k") < 3) / F.count(F.lit(1)), 1).alias("mean_attempts"))
    return by.unionByName(whole)


STATUS = f"""WITH {V.QUEUE} SELECT stage, count(*) AS items, min(ats) AS oldest, max(ats) AS last_updated, round(avg(k % 4), 1) AS mean_attempts FROM qu GROUP BY stage
UNION ALL SELECT 'all', count(*), min(ats) FILTER (WHERE failed), count(*) FILTER (WHERE failed), round(count(*) FILTER (WHERE k < 3) / count(*), 1) FROM qu"""


def host_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each creator's attendances by event, between 0 and 1, and 0 without events."""
    e = V.events(spark, sf_dir).filter("created_by is not null").select("event_id", F.col("created_by").alias("host_id"))
    going = V.attendees(spark, sf_dir).filter("status = 'going'").groupBy("event_id").agg(F.count(F.lit(1)).alias("going"))
    sums = e.join(going, "event_id", "left").groupBy("host_id").agg(F.count(F.lit(1)).alias("events"), F.sum(F.coalesce("going", F.lit(0))).alias("engaged"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("host_id")).join(sums, "host_id", "left")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("engaged") / F.col("events")))
    return c.select("host_id", F.coalesce("events", F.lit(0)).alias("events"), F.round(F.coalesce(score, F.lit(0.0)), 6).alias("reliability"))


HOST_RELIABILITY = f"""WITH {V.EVENTS},{V.ATTENDEES}, s AS (SELECT created_by AS host_id, count(*) AS events, sum(coalesce(attendee_count, 0)) AS engaged FROM ea WHERE created_by IS NOT NULL GROUP BY 1)
SELECT c_custkey AS host_id, coalesce(events, 0) AS events, round(coalesce(least(1.0::DOUBLE, engaged / events::DOUBLE), 0), 6) AS reliability FROM customer LEFT JOIN s ON host_id = c_custkey"""


def yields_and_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources' yields in descending order with their place, and failures by strategy and stage, as one report."""
    q = V.queue(spark, sf_dir)
    yields = q.groupBy(F.col("source_id").cast("string").alias("name")).agg(F.sum("k").cast("long").alias("n"))
    failures = q.filter("failed").groupBy(F.concat_ws("/", "strategy", F.when(F.col("k") < 5, "early").otherwise("late")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return yields.select(F.lit("yield").alias("report"), "name", "n").unionByName(failures.select(F.lit("failures").alias("report"), "name", "n")).orderBy("report", F.desc("n"), "name")


YIELDS = f"""WITH {V.QUEUE} SELECT 'yield' AS report, source_id::VARCHAR AS name, sum(k)::BIGINT AS n FROM qu GROUP BY 2 UNION ALL SELECT 'failures', strategy || '/' || CASE WHEN k < 5 THEN 'early' ELSE 'late' END, count(*) FROM qu WHERE failed GROUP BY 2"""


def validated_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' warnings and sanitised fields, with the batch's share of valid ones on each row's category."""
    e = V.events(spark, sf_dir)
    k = F.col("event_id")
    name, image, end = F.when(k % 10 == 0, "AB").otherwise(F.col("title")), F.when(k % 3 == 0, "img").otherwise(F.concat(F.lit("https://a.example/"), k.cast("string"))), F.when(k % 4 == 0, F.col("event_date"))
    lat = F.when(k % 7 == 0, 95.0).otherwise(F.col("lat"))
    errors = classify.validation_errors(name, F.upper("category"), F.lit("https://a.example/x"), F.lit("Zwolle"))
    warnings = classify.validation_warnings(name, F.col("description"), F.col("event_date"), end, image, lat, F.col("lng"))
    rows = e.select("event_id", "category", (F.size(errors) == 0).alias("ok"), F.array_join(warnings, "; ").alias("warnings"), F.when(k % 3 != 0, image).alias("image"), F.when(lat <= 90, lat).alias("lat"))
    stats = rows.groupBy("category").agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"), F.round(F.count_if("ok") / F.count(F.lit(1)), 6).alias("valid_rate"))
    kept = rows.filter("ok").select("event_id", "category", "warnings", "image", F.round("lat", 4).alias("lat"))
    return kept.join(F.broadcast(stats), "category")  # five categories by definition


VALIDATED_BATCH = f"""WITH {V.EVENTS}, x AS (SELECT event_id AS k, category, lat FROM ev), s AS (SELECT category, count(*) FILTER (WHERE k % 10 <> 0 AND category NOT IN ('none')) AS valid, count(*) FILTER (WHERE k % 10 = 0) AS invalid, round(count(*) FILTER (WHERE k % 10 <> 0) / count(*), 6) AS valid_rate FROM x GROUP BY 1)
SELECT k AS event_id, category, {joined(["CASE WHEN k % 4 = 0 THEN 'end_time is not after start_time' END", "CASE WHEN k % 3 = 0 THEN 'Invalid image_url' END", "CASE WHEN k % 7 = 0 THEN 'Invalid coordinates' END"])} AS warnings, CASE WHEN k % 3 <> 0 THEN 'https://a.example/' || k END AS image,
  CASE WHEN k % 7 <> 0 THEN round(lat, 4) END AS lat, valid, invalid, valid_rate FROM x JOIN s USING (category) WHERE k % 10 <> 0"""


def feed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds with a long prolog, an item or an entry a page, read by the feed's strategy first."""
    k = F.col("page_id").cast("string")
    prolog = F.concat(F.lit("<?xml version='1.0'?><!-- "), F.repeat(F.lit("x"), 3000), F.lit(" -->"))
    rss = F.concat(F.lit("<rss><channel><title>Site</title><item><title><![CDATA[Event "), k, F.lit(" & more]]></title><link>https://a.example/"), k, F.lit("</link><pubDate>Fri, 12 Jun 2026 20:00:00 GMT</pubDate></item><item><title></title></item></channel></rss>"))
    atom = F.concat(F.lit("<feed><entry><title>Event "), k, F.lit("</title><link href='https://a.example/"), k, F.lit("'/><updated>2026-06-12</updated></entry></feed>"))
    read = html.waterfall(table(spark, sf_dir, "pages").select("page_id", F.concat(prolog, F.when(F.col("page_id") % 2 == 0, rss).otherwise(atom)).alias("html")), "page_id", "html", preferred="feed")
    card = F.get("cards", F.lit(0))
    return read.select("page_id", "strategy", card["title"].alias("title"), card["date"].alias("date"), card["detail_url"].alias("url"), F.size("cards").alias("cards"))


FEED_CARDS = """SELECT page_id, 'feed' AS strategy, 'Event ' || page_id || CASE WHEN page_id % 2 = 0 THEN ' & more' ELSE '' END AS title, CASE WHEN page_id % 2 = 0 THEN 'Fri, 12 Jun 2026 20:00:00 GMT' ELSE '2026-06-12' END AS date, 'https://a.example/' || page_id AS url, 1 AS cards FROM pages"""

QUERIES = {
    "d4_page_times": (page_times, PAGE_TIMES), "f14_likely_urls": (likely_urls, LIKELY), "x16_repaired_json": (repaired_json, JSON), "y4_tagged": (tagged, TAGGED), "k22_latest_commitments": (latest_commitments, LATEST),
    "s15_bookmarks": (bookmarks, BOOKMARKS), "a4_status_summary": (status_summary, STATUS), "a8_host_reliability": (host_reliability, HOST_RELIABILITY), "a21_yields_and_failures": (yields_and_failures, YIELDS),
    "a25_validated_batch": (validated_batch, VALIDATED_BATCH), "s7_feed_cards": (feed_cards, FEED_CARDS),
}
