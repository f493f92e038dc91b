"""Queries of feed ranking, search, rails, rituals and groups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions import geo
from larkspan.operators import diversity, feed, groups, rituals, search, vector_index
from larkspan.plans import views as V
from larkspan.session import table
from larkspan.storage import new_path

_SCORES = f"""
sc AS (
  SELECT *, {V.distance_sql()} AS distance_km, (ats - {V.NOW}) / 86400.0::DOUBLE AS days, (ats - {V.NOW}) / 3600.0::DOUBLE AS hours FROM ea),
sp AS (
  SELECT *, CASE WHEN category IN ('music', 'foodie') THEN 1.0 ELSE 0.3 END::DOUBLE AS category_score,
    CASE WHEN days < 0 THEN 0.0 WHEN days < 1 THEN 1.0 ELSE greatest(0.1, exp(-days / 7)) END::DOUBLE AS time_score,
    CASE WHEN attendee_count <= 0 THEN 0.2 ELSE least(greatest(ln(attendee_count + 1) / ln(1000.0), 0.2), 1.0) END::DOUBLE AS social_score,
    coalesce(match_percentage, 50) / 100.0::DOUBLE AS match_score,
    CASE WHEN distance_km IS NULL THEN 0.5 WHEN distance_km <= 0.1 THEN 1.0 ELSE least(greatest(1 / (1 + distance_km / 12.5), 0.1), 1.0) END::DOUBLE AS distance_score,
    CASE WHEN hours < 0 THEN 0.1 WHEN hours <= 6 THEN 1.2 WHEN hours <= 24 THEN 1.15 WHEN hours <= 72 THEN 1.1 ELSE 1.0 END::DOUBLE AS urgency,
    CASE WHEN attendee_count >= 100 THEN 1.2 WHEN attendee_count >= 50 THEN 1.15 WHEN attendee_count >= 20 THEN 1.1 WHEN attendee_count >= 10 THEN 1.05 ELSE 1.0 END::DOUBLE AS trending,
    CASE WHEN category IN ('social', 'music', 'foodie') THEN 2.0 WHEN category = 'family' THEN 0.3 ELSE 1.0 END::DOUBLE AS mode_factor,
    CASE WHEN image_url IS NULL THEN 0.2 ELSE 1.0 END::DOUBLE * CASE WHEN length(description) < 50 THEN 0.8 ELSE 1.0 END::DOUBLE AS penalty
  FROM sc),
sb AS (SELECT *, category_score * 0.35 + time_score * 0.20 + social_score * 0.15 + match_score * 0.10 + distance_score * 0.20 AS base FROM sp)"""
_EV = f"WITH {V.EVENTS},\n{V.ATTENDEES}"


def _rank(ordered: DataFrame, *order) -> DataFrame:
    """Places of a page of rows, few by the limit that made it."""
    return ordered.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def personalised_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = feed.personalised_feed(V.events(spark, sf_dir), V.attendees(spark, sf_dir), V.hosts(spark, sf_dir), V.now(), V.LAT, V.LNG, 25.0, V.PREFERRED, "social")
    return page.select("event_id", "title", "category", "attendee_count", "host_name", "host_city", F.round("distance_km", 4).alias("distance_km"), F.round("final_score", 6).alias("final_score"))


PERSONALISED_FEED = f"""{_EV},{V.HOSTS},{_SCORES},
pg AS (SELECT *, least(1.5, base * urgency * trending * mode_factor) AS final_score FROM sb WHERE distance_km <= 25 ORDER BY final_score DESC, event_id LIMIT 20)
SELECT event_id, title, category, attendee_count, host_name, host_city, round(distance_km, 4) AS distance_km, round(final_score, 6) AS final_score
FROM pg LEFT JOIN ho ON created_by = host_id"""


def score_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = feed.client_rank(feed.with_attendees(V.events(spark, sf_dir), V.attendees(spark, sf_dir)), V.now(), V.LAT, V.LNG, 25.0, V.PREFERRED, "social")
    parts = ("category_score", "time_score", "social_score", "match_score", "distance_score", "urgency", "trending", "mode_factor", "final_score")
    return ranked.select("event_id", *[F.round(p, 6).alias(p) for p in parts])


SCORE_PARTS = f"""{_EV},{_SCORES}
SELECT event_id, round(category_score, 6) AS category_score, round(time_score, 6) AS time_score, round(social_score, 6) AS social_score,
  round(match_score, 6) AS match_score, round(distance_score, 6) AS distance_score, urgency, trending, mode_factor,
  round(base * least(urgency * trending, 1.5) * mode_factor * penalty, 6) AS final_score FROM sb"""


def diversified_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = feed.client_rank(feed.with_attendees(V.events(spark, sf_dir), V.attendees(spark, sf_dir)), V.now(), V.LAT, V.LNG, 25.0, V.PREFERRED)
    return diversity.diversified(ranked.withColumn("final_score", F.round("final_score", 9)))


#: Each step takes the best of the categories' heads; of two remembered categories the older one loses two thirds.
DIVERSIFIED_FEED = f"""{_EV.replace("WITH", "WITH RECURSIVE", 1)},{_SCORES},
pg AS (SELECT event_id, category, round(base * least(urgency * trending, 1.5) * penalty, 9) AS final_score FROM sb),
po AS (SELECT *, row_number() OVER (ORDER BY final_score DESC, event_id) AS pos FROM pg),
qu AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY category) AS queue, row_number() OVER (PARTITION BY category ORDER BY pos) AS n FROM po),
d AS (SELECT 0 AS place, NULL::BIGINT AS event_id, NULL::VARCHAR AS category, 0.0::DOUBLE AS final_score, 0.0::DOUBLE AS diverse_score, []::VARCHAR[] AS last,
        (SELECT list(1::BIGINT ORDER BY queue) FROM (SELECT DISTINCT queue FROM qu)) AS reached
UNION ALL SELECT place + 1, event_id, category, final_score, diverse, list_append(last, category)[-2:], [r + (i = queue)::BIGINT FOR r, i IN reached] FROM (
  SELECT *, row_number() OVER (ORDER BY diverse DESC, pos) AS rn FROM (
    SELECT h.place, h.last, h.reached, qu.*, qu.final_score * CASE WHEN list_contains(h.last, qu.category) THEN 1 - (len(h.last) - (list_position(h.last, qu.category) - 1)) / 3.0::DOUBLE ELSE 1.0::DOUBLE END AS diverse
    FROM (SELECT place, last, reached, unnest(reached) AS head, unnest(range(1, len(reached) + 1)) AS number FROM d) h JOIN qu ON qu.queue = h.number AND qu.n = h.head)) WHERE rn = 1)
SELECT event_id, category, final_score, diverse_score, place::BIGINT AS place FROM d WHERE place > 0"""


def nearby_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feed.nearby(V.events(spark, sf_dir), V.attendees(spark, sf_dir), V.LAT, V.LNG, 5.0, ["music", "family", "social"], ["anchor", "signal"])
    return found.select("event_id", "category", "event_type", "attendee_count", F.round("distance_km", 5).alias("distance_km"), geo.distance_label(F.col("distance_km")).alias("label"), geo.walking_label(F.col("distance_km")).alias("walk"))


NEARBY_EVENTS = f"""{_EV},
d AS (SELECT *, {V.distance_sql()} AS km FROM ea WHERE category IN ('music', 'family', 'social') AND event_type IN ('anchor', 'signal'))
SELECT event_id, category, event_type, attendee_count, round(km, 5) AS distance_km,
  CASE WHEN km < 0.1 THEN 'right here' WHEN km < 1 THEN (round(km * 1000 / 50) * 50)::INT::VARCHAR || 'm away' ELSE printf('%.1fkm away', km) END AS label,
  CASE WHEN round(km * 12) < 1 THEN '< 1 min walk' WHEN round(km * 12) > 60 THEN round(round(km * 12) / 60)::INT::VARCHAR || 'h walk' ELSE round(km * 12)::INT::VARCHAR || ' min walk' END AS walk
FROM d WHERE km <= 5 ORDER BY km, ats, event_id LIMIT 50"""


def mission_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.events(spark, sf_dir).withColumn("category", F.when(F.col("category") == "foodie", "dining").when(F.col("category") == "social", "bar").otherwise(F.col("category")))
    found = feed.mission_events(events, V.attendees(spark, sf_dir), "drinks", V.LAT, V.LNG, 18, V.now(), radius_km=3.0)
    return found.select("event_id", "category", "attendee_count", "walking_minutes", F.round("distance_km", 5).alias("distance_km"))


MISSION_EVENTS = f"""{_EV},
d AS (SELECT *, {V.distance_sql()} AS km FROM ea WHERE category IN ('foodie', 'social') AND ats >= {V.NOW - V.NOW % 86400})
SELECT event_id, CASE category WHEN 'foodie' THEN 'dining' ELSE 'bar' END AS category, attendee_count, round(km * 12)::INT AS walking_minutes, round(km, 5) AS distance_km
FROM d WHERE km <= 3 ORDER BY km, ats, event_id LIMIT 10"""


def friends_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feed.friends_pulse(V.relations(spark, sf_dir), V.attendees(spark, sf_dir), V.events(spark, sf_dir), 1, V.now())
    return found.filter(F.col("pulse") != "future").select("profile_id", "event_id", "pulse")


FRIENDS_PULSE = f"""{_EV},{V.RELATIONS}
SELECT DISTINCT att.profile_id, ev.event_id,
  CASE WHEN ev.ats // 86400 = {V.NOW // 86400} AND event_time IS NOT NULL THEN 'live' ELSE 'upcoming' END AS pulse
FROM re JOIN att ON following_id = profile_id AND att.status = 'going' JOIN ev ON ev.event_id = att.event_id
WHERE follower_id = 1 AND re.status = 'accepted' AND ev.ats >= {V.NOW - V.NOW % 86400}
  AND ((ev.ats // 86400 = {V.NOW // 86400} AND event_time IS NOT NULL) OR ev.ats BETWEEN {V.NOW} AND {V.NOW + 86400})"""


def event_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.stacks(V.events(spark, sf_dir)).select("event_id", "kind", F.array_join("forks", ",").alias("forks"))


EVENT_STACKS = f"""WITH {V.EVENTS},
fk AS (SELECT parent_event_id AS p, string_agg(event_id::VARCHAR, ',' ORDER BY ats, event_id) AS forks FROM ev WHERE event_type = 'fork' AND parent_event_id IS NOT NULL GROUP BY 1)
SELECT event_id, 'stack' AS kind, coalesce(forks, '') AS forks FROM ev LEFT JOIN fk ON p = event_id WHERE event_type = 'anchor'
UNION ALL SELECT event_id, 'single', '' FROM ev WHERE event_type = 'signal'
  OR (event_type = 'fork' AND (parent_event_id IS NULL OR parent_event_id NOT IN (SELECT event_id FROM ev WHERE event_type = 'anchor')))"""


def discovery_rails(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = feed.with_attendees(V.events(spark, sf_dir), V.attendees(spark, sf_dir))
    return feed.all_rails(events, {"now": V.now(), "lat": V.LAT, "lng": V.LNG, "radius_km": 25.0, "categories": V.PREFERRED})


DISCOVERY_RAILS = f"""{_EV},
x AS (SELECT *, {V.distance_sql()} AS km FROM ea),
r AS (
  SELECT 'for-you' AS rail, event_id, row_number() OVER (ORDER BY coalesce(match_percentage, 0) DESC, attendee_count DESC, event_id) AS rank FROM x WHERE category IN ('music', 'foodie')
  UNION ALL SELECT 'this-weekend', event_id, row_number() OVER (ORDER BY attendee_count DESC, ats, event_id) FROM x WHERE ats >= {(V.NOW // 86400 + 3) * 86400} AND ats < {(V.NOW // 86400 + 5) * 86400}
  UNION ALL SELECT 'location', event_id, row_number() OVER (ORDER BY km, event_id) FROM x WHERE km <= 12.5 AND ats >= {V.NOW}
  UNION ALL SELECT 'pulse', event_id, row_number() OVER (ORDER BY attendee_count DESC, event_id) FROM x WHERE ats >= {V.NOW}
  UNION ALL SELECT 'hidden-gems', event_id, row_number() OVER (ORDER BY coalesce(match_percentage, 0) DESC, event_id) FROM x WHERE attendee_count < 5 AND image_url IS NOT NULL AND ats > {V.NOW})
SELECT rail, rank, event_id FROM r WHERE rank <= 10"""


def live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = table(spark, sf_dir, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("blocked_id"))
    found = feed.live(V.events(spark, sf_dir), "1998-06-17", "18:00", V.LAT, V.LNG, ["music", "social"], blocked)
    return _rank(found, F.desc("is_relevant"), F.asc_nulls_last("distance_km"), "event_id").select("place", "event_id", "event_time", "is_relevant", F.round("distance_km", 5).alias("distance_km"))


LIVE_EVENTS = f"""WITH {V.EVENTS},
d AS (SELECT *, {V.distance_sql()} AS km, category IN ('music', 'social') AS is_relevant FROM ev
      WHERE ats // 86400 = {V.NOW // 86400} AND (event_time IS NULL OR event_time = 'TBD' OR event_time <= '18:00') AND (created_by IS NULL OR created_by % 7 <> 0))
SELECT row_number() OVER (ORDER BY is_relevant DESC, km, event_id) AS place, event_id, event_time, is_relevant, round(km, 5) AS distance_km FROM d"""


def ritual_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.events(spark, sf_dir).withColumn("description", F.lit(""))
    return rituals.rituals(events, V.now())


def ritual_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    went = V.attendees(spark, sf_dir).groupBy("profile_id", "event_id").agg(F.max(F.col("status") == "going").alias("attended"))
    dated = went.join(V.events(spark, sf_dir).select("event_id", "event_date"), "event_id")
    return rituals.streaks(dated, ["profile_id"], V.now())


RITUAL_STREAKS = f"""{_EV},
w AS (SELECT profile_id, event_id, max(status = 'going') AS attended FROM att GROUP BY ALL),
m AS (SELECT profile_id, sum(CASE WHEN attended THEN 0 ELSE 1 END) OVER (PARTITION BY profile_id ORDER BY ev.ats DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS misses
      FROM w JOIN ev USING (event_id) WHERE ev.ats <= {V.NOW})
SELECT profile_id, count(*) FILTER (WHERE misses = 0) AS streak FROM m GROUP BY profile_id"""


def similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.find_similar(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "event_id"), 0, threshold=0.2, limit=10)
    return found.select("event_id", F.round("similarity", 6).alias("similarity"))


_SIM = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
SIMILAR_VECTORS = f"""WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
s AS (SELECT e.vec_id AS event_id, {_SIM} AS similarity FROM embeddings e, q WHERE e.vec_id <> 0)
SELECT event_id, round(similarity, 6) AS similarity FROM s WHERE similarity > 0.2 ORDER BY similarity DESC, event_id LIMIT 10"""


def matched_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("event_id"), "embedding", F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"))
    query = search.vector_of(e, 3)
    return search.match(e, query, threshold=0.1, limit=10, category="c1").select("event_id", "category", F.round("similarity", 6).alias("similarity"))


MATCHED_VECTORS = f"""WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 3),
s AS (SELECT e.vec_id AS event_id, 'c' || e.label::VARCHAR AS category, {_SIM} AS similarity FROM embeddings e, q WHERE e.label = 1)
SELECT event_id, category, round(similarity, 6) AS similarity FROM s WHERE similarity > 0.1 ORDER BY similarity DESC, event_id LIMIT 10"""


def _index(spark: SparkSession, sf_dir: str) -> vector_index.Index:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("event_id"), "embedding", F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"))
    return vector_index.build(e, new_path(spark, "index"))


def indexed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    found = vector_index.match(index, search.vector_of(index.vectors, 3), threshold=0.1, limit=10, category="c1")
    return found.select("event_id", "category", F.round("similarity", 6).alias("similarity"))


def indexed_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_index.find_similar(_index(spark, sf_dir), 0, threshold=0.2, limit=10).select("event_id", F.round("similarity", 6).alias("similarity"))


def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th vector against all: the probes are tuned on other queries, and what they find is held against the exact answer."""
    index = _index(spark, sf_dir)
    queries = index.vectors.select(F.col("event_id").alias("query_id"), "embedding")
    asked = queries.filter("query_id % 20 = 0")
    probes = vector_index.tuned_probes(index, queries.filter("query_id % 20 = 1"))
    found = vector_index.recall(vector_index.search_many(index, asked, probes=probes), vector_index.search_many(index, asked))
    return found.select("queries", "neighbours", (F.col("recall") >= 0.9).alias("enough"))


INDEX_RECALL = """SELECT count(*) AS queries, 10 * count(*) AS neighbours, TRUE AS enough FROM embeddings WHERE vec_id % 20 = 0"""


def vibe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("event_id"), "embedding")
    placed = e.join(V.events(spark, sf_dir).select("event_id", "lat", "lng"), "event_id")
    found = search.by_vibe(placed, search.vector_of(e, 3), V.LAT, V.LNG, 60.0, threshold=0.0, limit=20)
    return found.select("event_id", F.round("similarity", 6).alias("similarity"), F.round("distance_km", 4).alias("distance_km"))


VIBE_SEARCH = f"""WITH {V.EVENTS}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 3),
s AS (SELECT e.vec_id AS event_id, {_SIM} AS similarity, {V.distance_sql()} AS km FROM embeddings e JOIN ev ON ev.event_id = e.vec_id, q)
SELECT event_id, round(similarity, 6) AS similarity, round(km, 4) AS distance_km FROM s WHERE similarity > 0.0 AND km <= 60 ORDER BY s.similarity DESC, event_id LIMIT 20"""


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("group_id"), F.col("c_custkey").alias("user_id"), (F.lit(52.0) + (F.col("c_custkey") * 37 % 400) / 1000.0).alias("lat"), (F.lit(4.4) + (F.col("c_custkey") * 53 % 600) / 1000.0).alias("lng"), F.when(F.col("c_custkey") % 3 == 0, 1.5).alias("weight"))


_PEOPLE = """pe AS (SELECT c_custkey % 50 AS group_id, c_custkey AS user_id, 52.0::DOUBLE + (c_custkey * 37 % 400) / 1000.0::DOUBLE AS lat,
  4.4::DOUBLE + (c_custkey * 53 % 600) / 1000.0::DOUBLE AS lng, CASE WHEN c_custkey % 3 = 0 THEN 1.5 END::DOUBLE AS weight FROM customer)"""


def group_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = groups.centroid(_people(spark, sf_dir), ["group_id"], "weight")
    return c.select("group_id", "members", *[F.round(x, 6).alias(x) for x in ("centre_lat", "centre_lng", "mean_km", "max_km")])


GROUP_CENTROIDS = f"""WITH {_PEOPLE},
c AS (SELECT group_id, sum(lat * coalesce(weight, 1.0)) / sum(coalesce(weight, 1.0)) AS clat, sum(lng * coalesce(weight, 1.0)) / sum(coalesce(weight, 1.0)) AS clng FROM pe GROUP BY group_id),
d AS (SELECT pe.*, clat, clng, pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clng - lng) / 2), 2) AS a FROM pe JOIN c USING (group_id)),
k AS (SELECT *, 12742.0::DOUBLE * atan2(sqrt(a), sqrt(1 - a)) AS km FROM d)
SELECT group_id, count(*) AS members, round(min(clat), 6) AS centre_lat, round(min(clng), 6) AS centre_lng, round(avg(km), 6) AS mean_km, round(max(km), 6) AS max_km FROM k GROUP BY group_id"""


def group_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = groups.majority_clusters(_people(spark, sf_dir), ["group_id"], 6.0)
    return h.select("group_id", "cluster", "members", F.round("hub_lat", 6).alias("hub_lat"), F.round("hub_lng", 6).alias("hub_lng"))


GROUP_HUBS = f"""WITH RECURSIVE {_PEOPLE},
ed AS (SELECT x.group_id, x.user_id AS a, y.user_id AS b FROM pe x JOIN pe y ON x.group_id = y.group_id AND x.user_id <> y.user_id
  AND 12742.0::DOUBLE * asin(sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lng - x.lng) / 2), 2))) <= 6),
re AS (SELECT DISTINCT a AS node, a AS root FROM ed UNION SELECT ed.b, re.root FROM re JOIN ed ON ed.a = re.node),
lb AS (SELECT node, min(root) AS cluster FROM re GROUP BY node),
cl AS (SELECT group_id, cluster, count(*) AS members, round(avg(lat), 6) AS hub_lat, round(avg(lng), 6) AS hub_lng FROM lb JOIN pe ON node = user_id GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY members DESC, cluster) AS n FROM cl)
SELECT group_id, cluster, members, hub_lat, hub_lng FROM rk WHERE n = 1"""


def _free(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return e.select((F.col("user_id") % 30).alias("group_id"), "user_id", (F.col("s") - F.col("s") % 1800).alias("start"), (F.col("s") - F.col("s") % 1800 + 1800 * (1 + F.col("event_id") % 20)).alias("end"))


_FREE = """fr AS (SELECT user_id % 30 AS group_id, user_id, (epoch_us(ts) // 1000000) - (epoch_us(ts) // 1000000) % 1800 AS s, (epoch_us(ts) // 1000000) - (epoch_us(ts) // 1000000) % 1800 + 1800 * (1 + event_id % 20) AS e
  FROM events)"""
_WINDOW = (1704585600, 1705190400)


def common_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = _free(spark, sf_dir)
    people = free.groupBy("group_id").agg(F.countDistinct("user_id").alias("total"))
    return groups.common_slots(free, ["group_id"], people, F.lit(_WINDOW[0]), F.lit(_WINDOW[1]))


COMMON_SLOTS = f"""WITH {_FREE},
tt AS (SELECT group_id, count(DISTINCT user_id) AS total FROM fr GROUP BY group_id),
bl AS (SELECT * FROM fr WHERE s < {_WINDOW[1]} AND e > {_WINDOW[0]}),
pt AS (SELECT group_id, s AS p FROM bl UNION SELECT group_id, e FROM bl),
iv AS (SELECT group_id, p, lead(p) OVER (PARTITION BY group_id ORDER BY p) AS q FROM pt),
us AS (SELECT iv.group_id, p, q, list_sort(list(DISTINCT user_id)) AS users FROM iv JOIN bl ON bl.group_id = iv.group_id AND s <= p AND e >= q GROUP BY ALL),
fl AS (SELECT *, CASE WHEN lag(q) OVER w = p AND lag(users) OVER w = users THEN 0 ELSE 1 END AS f FROM us WINDOW w AS (PARTITION BY group_id ORDER BY p)),
il AS (SELECT *, sum(f) OVER (PARTITION BY group_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS i FROM fl),
sl AS (SELECT group_id, i, min(p) AS slot_start, max(q) AS slot_end, len(any_value(users)) AS available FROM il GROUP BY group_id, i),
rk AS (SELECT sl.group_id, slot_start, slot_end, available, available = total AS is_universal,
  row_number() OVER (PARTITION BY sl.group_id ORDER BY available = total DESC, available DESC, slot_start) AS place FROM sl JOIN tt USING (group_id) WHERE slot_end - slot_start >= 3600)
SELECT group_id, place, slot_start, slot_end, available, is_universal FROM rk WHERE place <= 5"""


QUERIES = {
    "k1_personalised_feed": (personalised_feed, PERSONALISED_FEED), "m_score_parts": (score_parts, SCORE_PARTS), "k2_diversified_feed": (diversified_feed, DIVERSIFIED_FEED),
    "k8_nearby_events": (nearby_events, NEARBY_EVENTS), "k6_mission_events": (mission_events, MISSION_EVENTS), "k7_friends_pulse": (friends_pulse, FRIENDS_PULSE),
    "k12_event_stacks": (event_stacks, EVENT_STACKS), "k10_discovery_rails": (discovery_rails, DISCOVERY_RAILS), "k14_live_events": (live_events, LIVE_EVENTS),
    "k11_ritual_events": (ritual_events, None), "n5_ritual_streaks": (ritual_streaks, RITUAL_STREAKS), "k4_similar_vectors": (similar_vectors, SIMILAR_VECTORS),
    "k3_matched_vectors": (matched_vectors, MATCHED_VECTORS), "k5_vibe_search": (vibe_search, VIBE_SEARCH), "a26_group_centroids": (group_centroids, GROUP_CENTROIDS),
    "k3_indexed_vectors": (indexed_vectors, MATCHED_VECTORS), "k4_indexed_similar": (indexed_similar, SIMILAR_VECTORS), "v1_index_recall": (index_recall, INDEX_RECALL),
    "g5_group_hubs": (group_hubs, GROUP_HUBS), "g6_common_slots": (common_slots, COMMON_SLOTS),
}
