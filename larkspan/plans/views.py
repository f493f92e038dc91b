"""The library's roles played by the driver's tables, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.session import table

#: A fixed present: 1998-06-17 16:30 UTC, a Wednesday within the orders' dates.
NOW = 898101000
LAT, LNG = 52.37, 4.90
PREFERRED = ["music", "foodie"]

_TITLES = ("Weekly Jazz Night", "Harbour Walk", "Book Table", "Open Stage", "Market Tasting", "Chess Evening", "City Run")


def now():
    return F.timestamp_seconds(F.lit(NOW))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events around Amsterdam."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pick = lambda options, by: F.element_at(F.array(*[F.lit(x) for x in options]), (by + 1).cast("int"))
    return o.select(
        k.alias("event_id"),
        F.concat(pick(_TITLES, k % 7), F.lit(" #"), (k % 30).cast("string")).alias("title"),
        F.substring(F.repeat(F.lit("something to do together "), 4), 1, (k % 90).cast("int")).alias("description"),
        pick(("social", "family", "music", "foodie", "outdoors"), F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("category"),
        pick(("anchor", "fork", "fork", "signal", "anchor"), k % 5).alias("event_type"),
        F.when(k % 5 == 1, k - 1).when(k % 5 == 2, k - 2 + F.when(k % 4 == 0, 1).otherwise(0)).alias("parent_event_id"),
        F.concat(F.lit("Venue "), (k % 40).cast("string")).alias("venue_name"),
        F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (k % 24) * 3600).alias("event_date"),
        F.when(k % 9 == 0, F.lit(None)).when(k % 9 == 1, "TBD").otherwise(F.format_string("%02d:00", (k % 24))).alias("event_time"),
        F.when(k % 4 != 0, F.concat(F.lit("img/"), k.cast("string"))).alias("image_url"),
        F.when(k % 11 != 0, (k % 101).cast("int")).alias("match_percentage"),
        (F.lit(52.0) + (k * 37 % 800) / 1000.0).alias("lat"),
        (F.lit(4.4) + (k * 53 % 1000) / 1000.0).alias("lng"),
        F.when(k % 13 != 0, F.col("o_custkey")).alias("created_by"),
    )


EVENTS = """ev AS (
  SELECT o_orderkey AS event_id,
         ['Weekly Jazz Night', 'Harbour Walk', 'Book Table', 'Open Stage', 'Market Tasting', 'Chess Evening', 'City Run'][o_orderkey % 7 + 1] || ' #' || (o_orderkey % 30)::VARCHAR AS title,
         substr(repeat('something to do together ', 4), 1, o_orderkey % 90) AS description,
         ['social', 'family', 'music', 'foodie', 'outdoors'][substr(o_orderpriority, 1, 1)::INT] AS category,
         ['anchor', 'fork', 'fork', 'signal', 'anchor'][o_orderkey % 5 + 1] AS event_type,
         CASE WHEN o_orderkey % 5 = 1 THEN o_orderkey - 1 WHEN o_orderkey % 5 = 2 THEN o_orderkey - 2 + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END END AS parent_event_id,
         'Venue ' || (o_orderkey % 40)::VARCHAR AS venue_name,
         epoch(o_orderdate)::BIGINT + (o_orderkey % 24) * 3600 AS ats,
         CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN 'TBD' ELSE printf('%02d:00', o_orderkey % 24) END AS event_time,
         CASE WHEN o_orderkey % 4 <> 0 THEN 'img/' || o_orderkey::VARCHAR END AS image_url,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 101 END AS match_percentage,
         52.0::DOUBLE + (o_orderkey * 37 % 800) / 1000.0::DOUBLE AS lat,
         4.4::DOUBLE + (o_orderkey * 53 % 1000) / 1000.0::DOUBLE AS lng,
         CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS created_by
  FROM orders)"""


def attendees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as attendances."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("profile_id"), F.when(F.col("l_linestatus") == "O", "going").otherwise("declined").alias("status"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("joined_at"), F.col("l_linenumber").alias("place"))


ATTENDEES = """att AS (
  SELECT l_orderkey AS event_id, l_suppkey AS profile_id, CASE WHEN l_linestatus = 'O' THEN 'going' ELSE 'declined' END AS status,
         epoch(l_shipdate)::BIGINT AS joined_at, l_linenumber AS place FROM lineitem),
gc AS (SELECT event_id, count(*) FILTER (WHERE status = 'going') AS attendee_count FROM att GROUP BY event_id),
ea AS (SELECT ev.*, coalesce(gc.attendee_count, 0) AS attendee_count FROM ev LEFT JOIN gc USING (event_id))"""


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as hosts, with their nation and region."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    place = F.broadcast(n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name"))  # 25 rows by definition
    return c.join(place, c["c_nationkey"] == place["n_nationkey"]).select(F.col("c_custkey").alias("host_id"), F.col("c_name").alias("host_name"), F.col("n_name").alias("host_city"), F.least(F.greatest(F.col("c_acctbal") / 100.0, F.lit(0.0)), F.lit(100.0)).alias("host_reliability"))


HOSTS = """ho AS (
  SELECT c_custkey AS host_id, c_name AS host_name, n_name AS host_city, least(greatest(c_acctbal / 100.0::DOUBLE, 0.0), 100.0) AS host_reliability
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers following each other, by arithmetic."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return s.select(F.lit(1).cast("long").alias("follower_id"), F.col("k").alias("following_id"), F.when(F.col("k") % 3 == 0, "accepted").otherwise("pending").alias("status"))


RELATIONS = "re AS (SELECT 1 AS follower_id, s_suppkey AS following_id, CASE WHEN s_suppkey % 3 = 0 THEN 'accepted' ELSE 'pending' END AS status FROM supplier)"


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as items of a work queue: five sources' worth of users, stages from types."""
    return queue_of(table(spark, sf_dir, "events"))


def queue_of(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    stage = F.when(F.col("event_type") == "view", "discovered").when(F.col("event_type") == "click", "fetching").when(F.col("event_type") == "signup", "extracting").when(F.col("event_type") == "purchase", "indexed").otherwise("failed")
    return e.select(F.col("event_id").alias("item_id"), F.col("user_id").alias("source_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ats"), stage.alias("stage"), (F.col("event_type") == "error").alias("failed"), F.col("value"), k.alias("k"), F.concat(F.lit("strategy-"), (F.col("event_id") % 4).cast("string")).alias("strategy"))


QUEUE = """qu AS (
  SELECT event_id AS item_id, user_id AS source_id, (epoch_us(ts) // 1000000) AS ats,
         CASE event_type WHEN 'view' THEN 'discovered' WHEN 'click' THEN 'fetching' WHEN 'signup' THEN 'extracting' WHEN 'purchase' THEN 'indexed' ELSE 'failed' END AS stage,
         event_type = 'error' AS failed, value, json_extract_string(props, '$.k')::INT AS k, 'strategy-' || (event_id % 4)::VARCHAR AS strategy
  FROM events)"""


def distance_sql(lat: float = LAT, lng: float = LNG, at_lat: str = "lat", at_lng: str = "lng") -> str:
    """The haversine distance in SQL."""
    a = f"(pow(sin(radians({at_lat} - {lat}::DOUBLE) / 2), 2) + cos(radians({lat}::DOUBLE)) * cos(radians({at_lat})) * pow(sin(radians({at_lng} - {lng}::DOUBLE) / 2), 2))"
    return f"(12742.0::DOUBLE * atan2(sqrt({a}), sqrt(1 - {a})))"
