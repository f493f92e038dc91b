"""Queries of itineraries, places, structured-data scores and further operations reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions import classify, dates, geo, scoring, text
from larkspan.operators import changes, dedup, itinerary, ops
from larkspan.plans import views as V
from larkspan.session import table


def unified_itinerary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir).filter("created_by is not null")
    start = F.unix_seconds("event_date")
    part = lambda where, end: e.filter(where).select(F.col("created_by").alias("user_id"), F.col("event_id").alias("id"), start.alias("start"), end.alias("end"))
    none = F.lit(None).cast("long")
    calendar = part("event_id % 7 = 2", start + 86400 * 40).withColumn("id", F.col("id") + 10_000_000)
    return itinerary.timeline(part("event_id % 3 = 0", none), part("event_id % 2 = 0", none), calendar, "user_id").select("user_id", "id", "kind", "status", "conflicts", "day")


ITINERARY = f"""WITH {V.EVENTS}, e AS (SELECT created_by AS user_id, event_id AS id, ats AS s FROM ev WHERE created_by IS NOT NULL),
i AS (SELECT user_id, id, 'event' AS kind, 'confirmed' AS status, s, NULL::BIGINT AS e FROM e WHERE id % 3 = 0
  UNION ALL SELECT user_id, id, 'event', 'pending', s, NULL FROM e WHERE id % 2 = 0 AND id % 3 <> 0
  UNION ALL SELECT user_id, id + 10000000, 'calendar', 'tentative', s, s + 86400 * 40 FROM e WHERE id % 7 = 2)
SELECT user_id, id, kind, status, coalesce(lag(coalesce(e, s)) OVER w > s, false) OR coalesce(coalesce(e, s) > lead(s) OVER w, false) AS conflicts, strftime(make_timestamp(s * 1000000), '%A, %b %-d') AS day
FROM i WINDOW w AS (PARTITION BY user_id ORDER BY s, kind, id)"""


def proposal_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").select((c % 60).alias("group_id"), (F.lit(52.0) + (c * 37 % 400) / 1000.0).alias("lat"), (F.lit(4.4) + (c * 53 % 600) / 1000.0).alias("lng"), F.when(c % 3 == 0, 2.0).alias("weight"), (c == c % 60).alias("is_host"))
    return itinerary.proposal_anchors(people).select("group_id", *[F.round(x, 6).alias(x) for x in ("host_lat", "host_lng", "fair_lat", "fair_lng")])


ANCHORS = """WITH p AS (SELECT c_custkey % 60 AS group_id, 52.0::DOUBLE + (c_custkey * 37 % 400) / 1000.0::DOUBLE AS lat, 4.4::DOUBLE + (c_custkey * 53 % 600) / 1000.0::DOUBLE AS lng,
  CASE WHEN c_custkey % 3 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE * CASE WHEN c_custkey < 60 THEN 1.5 ELSE 1.0 END::DOUBLE AS w, c_custkey < 60 AS h FROM customer)
SELECT group_id, round(max(lat) FILTER (WHERE h), 6) AS host_lat, round(max(lng) FILTER (WHERE h), 6) AS host_lng, round(sum(lat * w) / sum(w), 6) AS fair_lat, round(sum(lng * w) / sum(w), 6) AS fair_lng
FROM p GROUP BY group_id HAVING count(*) FILTER (WHERE h) > 0"""


def selected_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("population")).join(table(spark, sf_dir, "nation"), "n_nationkey").select(F.col("n_name").alias("name"), "population")
    return itinerary.select_places(places, 2, 12)


PLACES = "SELECT n_name AS name, count(*) AS population FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(*) >= 2 ORDER BY population DESC, name LIMIT 12"


def structured_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness, social-five score and missing facts of events."""
    e = V.events(spark, sf_dir)
    k = F.col("event_id")
    address, language, mode = F.when(k % 6 != 0, "Street 1"), F.when(k % 8 != 0, "NL"), F.when(k % 10 != 0, "high")
    end = F.when(k % 5 == 0, "22:00")
    missing = scoring.missing_facts(time=F.col("event_time").isNotNull() & (F.col("event_time") != "TBD"), address=address.isNotNull(), language=language.isNotNull())
    return e.select(
        "event_id", F.round(classify.completeness(title=F.col("title"), description=F.col("description"), event_time=F.col("event_time"), venue_name=F.col("venue_name"), image_url=F.col("image_url"), category=F.col("category"), end_time=end), 6).alias("completeness"),
        scoring.social_five_score(F.col("event_time"), F.col("venue_name"), address, end, F.when(k % 7 == 0, 90), language, mode).alias("social_five"), F.array_join(missing, ",").alias("missing"),
    )


STRUCTURED = f"""WITH {V.EVENTS}
SELECT event_id, round(0.15 + CASE WHEN length(description) > 50 THEN 0.1 ELSE 0 END + CASE WHEN event_time <> 'TBD' THEN 0.05 ELSE 0 END + 0.1 + CASE WHEN image_url IS NOT NULL THEN 0.1 ELSE 0 END + 0.05
    + CASE WHEN event_id % 5 = 0 THEN 0.05 ELSE 0 END, 6)::DOUBLE AS completeness,
  (CASE WHEN event_time <> 'TBD' THEN 1 ELSE 0 END + CASE WHEN event_id % 6 <> 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 1 ELSE 0 END
    + CASE WHEN event_id % 8 <> 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 10 <> 0 THEN 1 ELSE 0 END)::INT AS social_five,
  array_to_string(list_filter([CASE WHEN event_time IS NULL OR event_time = 'TBD' THEN 'time' END, CASE WHEN event_id % 6 = 0 THEN 'address' END, CASE WHEN event_id % 8 = 0 THEN 'language' END], lambda x: x IS NOT NULL), ',') AS missing FROM ev"""


def prices_and_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    written = F.when(k % 3 == 0, F.format_string("€ %d.%03d,%02d", k % 9 + 1, k % 1000, k % 100)).when(k % 3 == 1, F.format_string("$%d,%03d.%02d", k % 9 + 1, k % 1000, k % 100)).otherwise(F.format_string("%d,%02d", k % 90, k % 100))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("MusicEvent", "FoodEvent", "Event", "Festival", "TheaterEvent")]), (k % 5 + 1).cast("int"))
    site = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("www.Eventbrite.com", "uitagenda.nl", "dorp.nl")]), (k % 3 + 1).cast("int")))
    return o.select(k.alias("order_id"), classify.european_price(written).alias("price"), classify.schema_category(kind).alias("category"), text.source_tier(site).alias("tier"), dates.persona((k % 7 + 1).cast("int"), (k % 24).cast("int"), F.when(k % 11 == 0, (k % 10) / 10.0)).alias("persona"), text.rolling_hash36(F.concat(F.lit("event|"), k.cast("string"))).alias("hash36"))


PRICES = """WITH RECURSIVE k AS (SELECT o_orderkey AS k FROM orders),
h AS (SELECT k, 'event|' || k::VARCHAR AS s, 1 AS i, 0::BIGINT AS h FROM k UNION ALL SELECT k, s, i + 1, ((h * 31 + unicode(s[i]) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 FROM h WHERE i <= length(s)),
f AS (SELECT k, h FROM h WHERE i = length(s) + 1)
SELECT k AS order_id, CASE k % 3 WHEN 2 THEN printf('%d.%02d', k % 90, k % 100) WHEN 1 THEN printf('%d.%03d%02d', k % 9 + 1, k % 1000, k % 100) ELSE printf('%d%03d.%02d', k % 9 + 1, k % 1000, k % 100) END::DOUBLE AS price,
  CASE k % 5 WHEN 0 THEN 'MUSIC' WHEN 1 THEN 'FOOD' WHEN 4 THEN 'CULTURE' ELSE 'COMMUNITY' END AS category, CASE k % 3 WHEN 0 THEN 'tier_1_metropolis' WHEN 1 THEN 'tier_2_regional' ELSE 'tier_3_hyperlocal' END AS tier,
  CASE WHEN k % 11 = 0 AND k % 10 <= 5 THEN 'professional' WHEN k % 7 NOT IN (0, 6) AND k % 24 BETWEEN 9 AND 16 THEN 'professional' WHEN k % 7 IN (0, 6) AND k % 24 < 14 THEN 'family' ELSE 'social' END AS persona,
  lower(to_base(abs(h), 36)) AS hash36 FROM f"""


def parsed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir)
    written = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("POINT("), F.col("lng").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit('{"type":"Point","coordinates":['), F.col("lng").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]}")))
    return e.select("event_id", F.expr("1").alias("one"), geo.parse_point(written).alias("p")).select("event_id", F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"))


POINTS = f"WITH {V.EVENTS} SELECT event_id, round(lat, 6) AS lat, round(lng, 6) AS lng FROM ev"


def audit_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of even number, into which all items are inserted twice: the others come in once."""
    q = V.queue(spark, sf_dir).select("item_id", "stage")
    late = q.withColumn("stage", F.lit("late"))
    return changes.insert_new(q.filter("item_id % 2 = 0"), late.unionByName(late), ["item_id"])


INSERTS = f"WITH {V.QUEUE} SELECT item_id, CASE WHEN item_id % 2 = 0 THEN stage ELSE 'late' END AS stage FROM qu"


def source_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return changes.tiers(p, [(1, ["%example.com%"]), (2, ["%BLOG%", "%shop%"])]).select("page_id", "tier")


TIERS = "SELECT page_id, CASE WHEN url ILIKE '%BLOG%' OR url ILIKE '%shop%' THEN 2 WHEN url ILIKE '%example.com%' THEN 1 ELSE 3 END AS tier FROM pages"


def method_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, yield, rate and distinct sources of each strategy and stage, with the yield's place."""
    q = V.queue(spark, sf_dir)
    out = q.groupBy("strategy", "stage").agg(F.count(F.lit(1)).alias("runs"), F.sum("k").cast("long").alias("found"), F.round(F.avg("k"), 6).alias("mean_found"), F.countDistinct("source_id").alias("sources"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("found"), "stage")))


INSIGHTS = f"""WITH {V.QUEUE}, g AS (SELECT strategy, stage, count(*) AS runs, sum(k)::BIGINT AS found, round(avg(k), 6) AS mean_found, count(DISTINCT source_id) AS sources FROM qu GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY found DESC, stage) AS place FROM g"""


def dedup_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents, those that repeat an earlier text, and the share; parenting words in conversations by turn."""
    d = table(spark, sf_dir, "documents")
    sizes = d.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").cast("long").alias("total"), F.count(F.lit(1)).alias("unique_texts"), F.sum(F.col("n") - 1).cast("long").alias("duplicates")).withColumn("rate", F.round(F.col("duplicates") / F.nullif("total", F.lit(0)), 6))


DEDUP_STATS = "WITH s AS (SELECT sha256(coalesce(text, '')) AS h, count(*) AS n FROM documents GROUP BY 1) SELECT sum(n)::BIGINT AS total, count(*) AS unique_texts, sum(n - 1)::BIGINT AS duplicates, round(sum(n - 1) / sum(n), 6) AS rate FROM s"


def signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation that hold one of a few words, counted once a turn, and whether there are more than three."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count_if(F.lower("text").rlike("the|and|les|der")).alias("signals"), F.count(F.lit(1)).alias("turns")).withColumn("flagged", F.col("signals") > 3)


SIGNALS = "SELECT conv_id, count(*) FILTER (WHERE regexp_matches(lower(text), 'the|and|les|der')) AS signals, count(*) AS turns, count(*) FILTER (WHERE regexp_matches(lower(text), 'the|and|les|der')) > 3 AS flagged FROM conversations GROUP BY 1"


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest event of each title and category, as a distinct-on."""
    return dedup.first_of(V.events(spark, sf_dir), ["title", "category"], [F.asc("event_date"), F.asc("event_id")]).select("title", "category", "event_id")


FIRST_ROWS = f"WITH {V.EVENTS} SELECT DISTINCT ON (title, category) title, category, event_id FROM ev ORDER BY title, category, ats, event_id"


def geocode_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's first cached key, by the order of its variants and then by hits."""
    e = V.events(spark, sf_dir)
    street = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Rue d'Été "), (F.col("event_id") % 5).cast("string")))
    keys = e.select("event_id", F.posexplode(text.key_variants(F.col("venue_name"), street, F.lit("1012 AB"), F.lit("Amsterdam"))).alias("at", "key"))
    cache = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("venue "), (F.col("s_suppkey") % 40).cast("string"), F.lit(" amsterdam"))).otherwise(F.concat(F.lit("rue d ete "), (F.col("s_suppkey") % 5).cast("string"), F.lit(" amsterdam"))).alias("key"), F.col("s_suppkey").alias("cache_id"), (F.col("s_suppkey") % 13).alias("hits"))
    best = cache.groupBy("key").agg(F.max_by("cache_id", F.struct("hits", -F.col("cache_id"))).alias("cache_id"))  # one entry a key, so that a join makes no more rows than there are variants
    return dedup.first_of(keys.join(best, "key"), ["event_id"], [F.asc("at")]).select("event_id", "key", "cache_id")


GEOCODE = f"""WITH {V.EVENTS}, c AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'venue ' || (s_suppkey % 40)::VARCHAR || ' amsterdam' ELSE 'rue d ete ' || (s_suppkey % 5)::VARCHAR || ' amsterdam' END AS key, s_suppkey AS cache_id, s_suppkey % 13 AS hits FROM supplier),
k AS (SELECT event_id, 1 AS at_, lower(venue_name) || ' amsterdam' AS key FROM ev UNION ALL SELECT event_id, 2, 'rue d ete ' || (event_id % 5)::VARCHAR || ' amsterdam' FROM ev WHERE event_id % 3 = 0),
r AS (SELECT event_id, k.key, cache_id, row_number() OVER (PARTITION BY event_id ORDER BY at_, hits DESC, cache_id) AS n FROM k JOIN c USING (key))
SELECT event_id, key, cache_id FROM r WHERE n = 1"""


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that fail and are indexed, that only fail, and all of either, by one flag each."""
    q = V.queue(spark, sf_dir)
    failing, indexed = q.filter("failed").select("source_id").distinct(), q.filter("stage = 'indexed'").select("source_id").distinct()
    return failing.intersect(indexed).withColumn("kind", F.lit("both")).unionByName(failing.exceptAll(indexed).withColumn("kind", F.lit("only failing"))).unionByName(failing.union(indexed).distinct().withColumn("kind", F.lit("either")))


SETS = f"""WITH {V.QUEUE}, f AS (SELECT DISTINCT source_id FROM qu WHERE failed), i AS (SELECT DISTINCT source_id FROM qu WHERE stage = 'indexed')
SELECT source_id, 'both' AS kind FROM (SELECT * FROM f INTERSECT SELECT * FROM i) UNION ALL SELECT source_id, 'only failing' FROM (SELECT * FROM f EXCEPT SELECT * FROM i) UNION ALL SELECT source_id, 'either' FROM (SELECT * FROM f UNION SELECT * FROM i)"""


def keyed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of urgent orders, then of high ones: each once, where it came first, with its last order."""
    o = table(spark, sf_dir, "orders")
    lists = [o.filter(F.col("o_orderpriority") == p).select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("latest"), F.col("o_orderkey").alias("place")) for p in ("1-URGENT", "2-HIGH")]
    return changes.keyed_union(lists, "customer", "place")


KEYED_UNION = """WITH u AS (SELECT o_custkey AS customer, o_orderkey AS latest, CASE o_orderpriority WHEN '1-URGENT' THEN 0 ELSE 1 END * 1000000000000 + o_orderkey AS at_ FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
k AS (SELECT customer, arg_max(latest, at_) AS latest, min(at_) AS first FROM u GROUP BY customer)
SELECT customer, latest, row_number() OVER (ORDER BY first) AS place FROM k"""


def marked_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items of the queue: every third is indexed, the others are held against them by their content."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.sha2("text", 256).alias("content_hash"), F.when(F.col("doc_id") % 3 == 0, "indexed").otherwise("extracting").alias("stage"))
    return changes.marked_duplicates(d.filter("stage = 'extracting'"), d).select("item_id", "stage", "duplicate_of", "last_failure_reason")


MARKED = """WITH d AS (SELECT doc_id, sha256(text) AS h, doc_id % 3 = 0 AS indexed FROM documents), o AS (SELECT h, min(doc_id) AS item FROM d WHERE indexed AND h IS NOT NULL GROUP BY h HAVING count(*) = 1)
SELECT doc_id AS item_id, CASE WHEN item IS NULL THEN 'extracting' ELSE 'failed' END AS stage, item AS duplicate_of, CASE WHEN item IS NOT NULL THEN 'Duplicate detected' END AS last_failure_reason FROM d LEFT JOIN o USING (h) WHERE NOT coalesce(indexed, true)"""


def queue_by_source_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality board: daily statistics of the last days for a few sources, newest day first."""
    stats = ops.daily_source_stats(V.queue(spark, sf_dir))
    last = 19753  # 2024-01-31 in days
    return stats.filter((F.col("day") > last - 14) & F.col("source_id").isin(1, 2, 3, 4, 5)).orderBy(F.desc("day"), "source_id").select("day", "source_id", "items", "indexed", "failed")


BOARD = f"""WITH {V.QUEUE} SELECT ats // 86400 AS day, source_id, count(*) AS items, count(*) FILTER (WHERE stage = 'indexed') AS indexed, count(*) FILTER (WHERE failed) AS failed FROM qu
WHERE ats // 86400 > 19739 AND source_id IN (1, 2, 3, 4, 5) GROUP BY 1, 2"""

QUERIES = {
    "k13_unified_itinerary": (unified_itinerary, ITINERARY), "k15_proposal_anchors": (proposal_anchors, ANCHORS), "k17_selected_places": (selected_places, PLACES), "m14_structured_scores": (structured_scores, STRUCTURED),
    "c11_prices_and_types": (prices_and_types, PRICES), "g3_parsed_points": (parsed_points, POINTS), "s19_audit_inserts": (audit_inserts, INSERTS), "l9_source_tiers": (source_tiers, TIERS),
    "a20_method_insights": (method_insights, INSIGHTS), "a25_dedup_statistics": (dedup_statistics, DEDUP_STATS), "a28_signal_counts": (signal_counts, SIGNALS), "n3_first_rows": (first_rows, FIRST_ROWS),
    "j18_geocode_variants": (geocode_variants, GEOCODE), "u_set_operations": (set_operations, SETS), "u4_keyed_union": (keyed_union, KEYED_UNION), "j20_marked_duplicates": (marked_duplicates, MARKED), "k18_quality_board": (queue_by_source_day, BOARD),
}
