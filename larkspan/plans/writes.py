"""Queries of labels, opening hours, look-ups, writes and monitoring rules, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import dates, geo, labels, text, vectors
from larkspan.operators import changes, ops
from larkspan.plans import views as V
from larkspan.plans.operations import _SOURCES, _sources
from larkspan.plans.samples import dealt, dealt_sql, quoted
from larkspan.session import table
from larkspan.streaming import windows

TODAY = "1998-06-17"


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))


_SHOWN_TIMES = ["20:00", "9:30", "TBD", "all day", "Avond", None, "", "later"]
_VENUES = ["Paradiso", "Unknown", "Stadion Galgenwaard", "Kras Stadion Volendam", "AFAS Live!", None, "de", "Grolsch Veste", "unknown location", "Ziggo Dome Amsterdam"]


def shown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = F.lit(TODAY).cast("date")
    date = F.date_add(today, (F.col("k") % 40 - 5).cast("int"))
    time, venue = dealt("k", _SHOWN_TIMES), dealt("k", _VENUES)
    return _numbers(spark, sf_dir).select(
        F.col("k").alias("event_id"), labels.date_label(date, today).alias("pill"), labels.date_label(date, today, full=True).alias("full_date"), labels.relative_day(date, today).alias("relative"), labels.padded_time(time).alias("padded"),
        labels.time_label(time, F.col("k") % 17 == 0).alias("time"), labels.place_label(dealt("k", [None, "Hall", ""], 3), dealt("k", [None, "Street 1"], 5), venue).alias("place"),
    )


_DAY = "(DATE '1998-06-17' + (k % 40 - 5)::INT)"


def _named(names: list[str], part: str) -> str:
    return f"[{', '.join(map(quoted, names))}][{part}]"


LABELS = f"""WITH d AS (SELECT o_orderkey AS k FROM orders), x AS (SELECT k, {_DAY} AS d, {dealt_sql('k', _SHOWN_TIMES)} AS t, {dealt_sql('k', _VENUES)} AS v FROM d),
y AS (SELECT *, CASE d WHEN DATE '1998-06-17' THEN 'Vandaag' WHEN DATE '1998-06-18' THEN 'Morgen' END AS near FROM x)
SELECT k AS event_id, coalesce(near, {_named(labels.SHORT_WEEKDAYS, 'isodow(d)')} || ' ' || day(d)) AS pill, coalesce(near, {_named(labels.WEEKDAYS, 'isodow(d)')} || ' ' || day(d) || ' ' || {_named(labels.MONTHS, 'month(d)')}) AS full_date,
  coalesce(near, CASE WHEN d BETWEEN DATE '1998-06-15' AND DATE '1998-06-21' THEN {_named(labels.WEEKDAYS, 'isodow(d)')} ELSE day(d) || ' ' || {_named(labels.SHORT_MONTHS, 'month(d)')} END) AS relative,
  CASE WHEN t = '9:30' THEN '09:30' ELSE coalesce(t, '') END AS padded, CASE WHEN k % 17 = 0 THEN 'Hele dag' WHEN t = 'TBD' THEN '' WHEN t = 'all day' THEN 'Hele dag' WHEN t = '9:30' THEN '09:30' ELSE coalesce(t, '') END AS time,
  coalesce(nullif({dealt_sql('k', [None, 'Hall', ''], 3)}, ''), {dealt_sql('k', [None, 'Street 1'], 5)}, CASE WHEN lower(v) NOT LIKE 'unknown%' THEN v END, 'Locatie onbekend') AS place FROM y"""

_HOURS = [{"monday": ["09:00-12:00", "13:00-17:30"], "friday": ["20:00-23:59"]}, {"wednesday": ["25:00-26:00", "10:00-11:00"]}, {}, {"sunday": ["12:00-18:00"], "wednesday": []}]
_DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()


def _hours_column():
    maps = [F.from_json(F.lit(json.dumps(h)), "map<string, array<string>>") for h in _HOURS]
    return F.element_at(F.array(*maps), (F.col("k") % len(_HOURS) + 1).cast("int"))


def opening_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir).select("k", _hours_column().alias("h"), dealt("k", _DAYS, 4).alias("day"), F.format_string("%02d:%02d", F.col("k") % 24, F.col("k") % 60).alias("t"))
    return rows.select(F.col("k").alias("venue_id"), dates.open_at(F.col("h"), F.col("day"), F.col("t")).alias("is_open"), dates.next_opening(F.col("h"), F.col("day")).alias("next_opening"), labels.closing_time(F.col("h"), F.col("day"), F.col("t")).alias("closes"))


#: Ranges as rows: number of the hours, weekday from 0, place among the day's ranges, start and end.
_RANGES = ", ".join(f"({i}, {_DAYS.index(d)}, {n}, {quoted(r[:5])}, {quoted(r[6:])})" for i, h in enumerate(_HOURS) for d, rs in h.items() for n, r in enumerate(rs))
OPENING = f"""WITH r(i, day, n, a, b) AS (VALUES {_RANGES}), d AS (SELECT o_orderkey AS k, o_orderkey % 4 AS i, o_orderkey // 4 % 7 AS day, printf('%02d:%02d', o_orderkey % 24, o_orderkey % 60) AS t FROM orders),
o AS (SELECT k, min(r.n) AS n, min_by(r.b, r.n) AS b FROM d JOIN r ON r.i = d.i AND r.day = d.day AND r.a <= t AND t < r.b AND r.b < '24:00' GROUP BY k),
x AS (SELECT k, min_by(['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday'][r.day + 1] || ' ' || r.a, (r.day - d.day + 7) % 7 * 10 + r.n) AS nxt FROM d JOIN r ON r.i = d.i GROUP BY k)
SELECT d.k AS venue_id, o.k IS NOT NULL AS is_open, x.nxt AS next_opening, o.b AS closes FROM d LEFT JOIN o ON o.k = d.k LEFT JOIN x ON x.k = d.k"""

_CRONS = ["*/5 * * * *", "30 16 * * *", "0 0 1 1 0", "* * * * 3", "30 16 17 6 3", "*/7 */4 * * *", "30 * * *", "x * * * *", "* * * * 0"]


def due_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_seconds(F.lit(V.NOW) + F.col("k") % 7 * 60)
    return _numbers(spark, sf_dir).select(F.col("k").alias("job_id"), labels.cron_due(dealt("k", _CRONS, 7), at).alias("due"))


DUE = f"""WITH d AS (SELECT o_orderkey AS k, make_timestamp(({V.NOW} + o_orderkey % 7 * 60) * 1000000) AS t, o_orderkey // 7 % 9 AS c FROM orders), x AS (SELECT k, c, minute(t) AS mi, hour(t) AS h FROM d)
SELECT k AS job_id, CASE c WHEN 0 THEN mi % 5 = 0 WHEN 1 THEN mi = 30 AND h = 16 WHEN 3 THEN true WHEN 4 THEN mi = 30 AND h = 16 WHEN 5 THEN mi % 7 = 0 AND h % 4 = 0 ELSE false END AS due FROM x"""


def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = dates.instant(dealt("k", ["1998-06-17", "1998-12-31"], 3), dealt("k", ["23:30", None, "06:15", "20:00"]))
    end = dealt("k", ["01:00", "07:30", "05:00", "23:00"], 5)
    weekday, hour = F.col("k") % 7 + 1, F.col("k") % 24
    return _numbers(spark, sf_dir).select(
        F.col("k").alias("event_id"), F.unix_seconds(start).alias("starts"), F.unix_seconds(dates.late_end(start, end)).alias("ends"), dates.persona(weekday, hour, F.when(F.col("k") % 5 == 0, 0.25)).alias("persona"),
        geo.distance_label(F.col("k") % 64 / 16.0).alias("distance"), geo.walking_label(F.col("k") % 97 / 16.0).alias("walk"),
    )


INSTANTS = f"""WITH d AS (SELECT o_orderkey AS k, {dealt_sql('o_orderkey', ['1998-06-17', '1998-12-31'], 3)} AS day, coalesce({dealt_sql('o_orderkey', ['23:30', None, '06:15', '20:00'])}, '12:00') AS t, {dealt_sql('o_orderkey', ['01:00', '07:30', '05:00', '23:00'], 5)} AS e,
  o_orderkey % 7 + 1 AS w, o_orderkey % 24 AS h, o_orderkey % 64 / 16.0::DOUBLE AS km, o_orderkey % 97 / 16.0::DOUBLE AS far FROM orders)
SELECT k AS event_id, epoch((day || ' ' || t)::TIMESTAMP)::BIGINT AS starts, (epoch((day || ' ' || e)::TIMESTAMP) + CASE WHEN (t >= '22' AND e < '08') OR (t < '08' AND e < '08' AND e[1:2] < t[1:2]) THEN 86400 ELSE 0 END)::BIGINT AS ends,
  CASE WHEN k % 5 = 0 OR (w BETWEEN 2 AND 6 AND h BETWEEN 9 AND 16) THEN 'professional' WHEN w IN (1, 7) AND h < 14 THEN 'family' ELSE 'social' END AS persona,
  CASE WHEN km < 0.1 THEN 'right here' WHEN km < 1 THEN (round(km * 20) * 50)::INT || 'm away' ELSE printf('%.1fkm away', km + 1e-9) END AS distance,
  CASE WHEN round(far * 12) < 1 THEN '< 1 min walk' WHEN round(far * 12) > 60 THEN round(round(far * 12) / 60)::INT || 'h walk' ELSE round(far * 12)::INT || ' min walk' END AS walk FROM d"""

def _base36(n: int) -> str:
    return (_base36(n // 36) if n >= 36 else "") + "0123456789abcdefghijklmnopqrstuvwxyz"[n % 36]


def _rolled(s: str) -> str:
    h = 0
    for c in s:
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    return _base36(abs(h))


_INPUTS = ["<b>plain</b>", " +31612345678 ", "+0123", "+31612345678", "x" * 3, None]


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    venue = dealt("k", _VENUES)
    address = labels.structured_address(venue, dealt("k", ["Street 1", None, ""], 3), dealt("k", ["Zwolle", None], 5), F.lit("1012 AB"))
    return _numbers(spark, sf_dir).select(
        F.col("k").alias("event_id"), labels.inferred_city(venue).alias("city"), labels.venue_of(venue)["name"].alias("venue"), F.to_json(address).alias("address"), labels.ordinal(F.col("k") % 125).alias("ordinal"),
        labels.possessive(dealt("k", ["Anna", "Lucas"])).alias("owner"), labels.clean_input(dealt("k", _INPUTS)).alias("clean"), labels.is_phone(dealt("k", _INPUTS)).alias("phone"),
        labels.payload_hash(dealt("k", ["Jazz", None], 2), F.lit("1998-05-01"), venue, F.repeat(F.lit("ab"), (F.col("k") % 400).cast("int")), F.lit(None).cast("string")).alias("payload"),
        text.embedding_text(dealt("k", ["Jazz", None], 2), F.repeat(F.lit("ab "), (F.col("k") % 900).cast("int"))).alias("embedded"), text.rolling_hash36(F.concat(F.lit("abc"), (F.col("k") % 10).cast("string"))).alias("rolling"),
    )


_CITY = ["Amsterdam", None, "Galgenwaard", "Volendam", "Amsterdam", None, "Utrecht", None, None, "Amsterdam"]
LOOKED_UP = f"""WITH d AS (SELECT o_orderkey AS k, {dealt_sql('o_orderkey', _VENUES)} AS v, nullif({dealt_sql('o_orderkey', ['Street 1', None, ''], 3)}, '') AS street, {dealt_sql('o_orderkey', ['Zwolle', None], 5)} AS city, {dealt_sql('o_orderkey', ['Jazz', None], 2)} AS title, o_orderkey % 125 AS n FROM orders)
SELECT k AS event_id, {dealt_sql('k', _CITY)} AS city, {dealt_sql('k', ['Paradiso', None, None, None, 'AFAS Live', None, 'TivoliVredenburg', None, None, 'Ziggo Dome'])} AS venue,
  CASE WHEN v IS NOT NULL THEN '{{"venue":"' || v || '"' || CASE WHEN street IS NULL THEN '' ELSE ',"street":"' || street || '"' END || CASE WHEN city IS NULL THEN '' ELSE ',"city":"' || city || '"' END || ',"postal_code":"1012 AB","country":"Netherlands"}}' END AS address,
  n || CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal, {dealt_sql('k', ["Anna's", "Lucas'"])} AS owner,
  {dealt_sql('k', ['bplain/b', '+31612345678', '+0123', '+31612345678', 'xxx', None])} AS clean, k % 6 = 3 AS phone,
  sha256('{{' || CASE WHEN title IS NULL THEN '' ELSE '"title":"Jazz",' END || '"date":"1998-05-01"' || CASE WHEN v IS NULL THEN '' ELSE ',"location":"' || v || '"' END || ',"description":"' || substr(repeat('ab', (k % 400)::INT), 1, 500) || '"}}') AS payload,
  substr(CASE WHEN title IS NULL THEN '' ELSE title || ' ' END || repeat('ab ', (k % 900)::INT), 1, 2000) AS embedded, {dealt_sql('k', [_rolled(f'abc{i}') for i in range(10)])} AS rolling FROM d"""
def padded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", vectors.zero_padded(F.col("embedding").cast("array<double>"), 1536).alias("v"))
    return v.select("vec_id", F.size("v").alias("length"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 4).alias("squares"), F.element_at("v", -1).alias("last"))


PADDED = "SELECT vec_id, 1536 AS length, round(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding]), 4) AS squares, 0.0::DOUBLE AS last FROM embeddings"


def missing_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = V.events(spark, sf_dir).select("event_id", F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, 0.0).otherwise(F.col("lat")).alias("lat"), F.when(k % 7 == 0, 0.0).when(k % 11 == 0, F.lit(None)).otherwise(F.col("lng")).alias("lng"))
    return e.filter(geo.needs_location(F.col("lat"), F.col("lng"))).select("event_id")


MISSING = "SELECT o_orderkey AS event_id FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0"


def _staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.queue(spark, sf_dir).select(F.col("item_id"), "source_id", F.when(F.col("k") % 3 == 0, "pending").otherwise("done").alias("status"), F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("payload"))


def enqueued_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after calls with JSON arrays of two jobs each, and in how far the sources' next times moved."""
    s = F.col("s_suppkey")
    calls = table(spark, sf_dir, "supplier").select(F.format_string('[{"source_id": %d, "payload": "{\\"n\\": 1}", "next_scrape_at": %d}, {"source_id": %d}]', s, s * 10, s + 1).alias("jobs"))
    sources = table(spark, sf_dir, "supplier").select(s.alias("source_id"), F.lit(5).cast("long").alias("next_scrape_at"))
    _, queue, moved = changes.enqueued(calls, _staging(spark, sf_dir).drop("item_id"), sources)
    counts = queue.groupBy("source_id", "status").agg(F.count(F.lit(1)).alias("jobs"), F.min("payload").alias("first_payload"))
    return counts.join(moved, "source_id", "left")


ENQUEUED = f"""WITH {V.QUEUE}, j AS (SELECT s_suppkey AS source_id, '{{"n": 1}}' AS payload, s_suppkey * 10 AS nxt FROM supplier UNION ALL SELECT s_suppkey + 1, '{{}}', NULL FROM supplier),
q AS (SELECT source_id, CASE WHEN k % 3 = 0 THEN 'pending' ELSE 'done' END AS status, 'p' || item_id AS payload FROM qu),
a AS (SELECT * FROM q WHERE NOT (status = 'pending' AND source_id IN (SELECT source_id FROM j)) UNION ALL SELECT source_id, 'pending', payload FROM j),
c AS (SELECT source_id, status, count(*) AS jobs, min(payload) AS first_payload FROM a GROUP BY ALL), m AS (SELECT s_suppkey AS source_id, s_suppkey * 10 AS next_scrape_at FROM supplier)
SELECT c.*, m.next_scrape_at FROM c LEFT JOIN m USING (source_id)"""


def requeued_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir).select("image_url", F.concat(F.lit("u"), (F.col("event_id") % 2000).cast("string")).alias("source_url"), F.col("created_by").alias("source_id"), F.unix_seconds("event_date").alias("ats"))
    staging = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), (F.col("c_custkey") * 2).cast("string")).alias("source_url"), F.lit(0).cast("long").alias("source_id"), F.lit("done").alias("status"), F.lit("html").alias("parsing_method"), F.lit(1).cast("long").alias("updated_at"))
    return changes.requeued(e, staging, V.NOW)


REQUEUED = f"""WITH {V.EVENTS}, p AS (SELECT 'u' || event_id % 2000 AS source_url, min(created_by) AS source_id FROM ev WHERE image_url IS NULL AND ats >= {V.NOW} GROUP BY 1),
s AS (SELECT 'u' || c_custkey * 2 AS source_url FROM customer)
SELECT source_url, CASE WHEN s.source_url IS NOT NULL THEN 0 ELSE p.source_id END AS source_id, CASE WHEN p.source_url IS NOT NULL THEN 'pending' ELSE 'done' END AS status, CASE WHEN s.source_url IS NOT NULL THEN 'html' ELSE 'ai' END AS parsing_method,
  CASE WHEN p.source_url IS NOT NULL THEN {V.NOW} ELSE 1 END AS updated_at FROM p FULL JOIN s USING (source_url)"""


def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sources(spark, sf_dir).select("source_id", F.col("failures").alias("errors"))
    q = V.queue(spark, sf_dir)
    return changes.counted_errors(s, q.filter("failed").select("source_id"), q.filter("stage = 'indexed'").select("source_id"))


ERROR_COUNTS = f"""WITH {V.QUEUE}, {_SOURCES} SELECT source_id, CASE WHEN source_id IN (SELECT source_id FROM qu WHERE stage = 'indexed') THEN 0 WHEN source_id IN (SELECT source_id FROM qu WHERE failed) THEN failures + 1 ELSE failures END AS errors FROM so"""


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.queue(spark, sf_dir)
    i = F.col("item_id")
    return q.select(F.col("source_id").alias("item_id"), "ats", i.alias("move_id"), F.element_at(F.array(*[F.lit(x) for x in changes.STAGES]), (i % 15 + 1).cast("int")).alias("next_stage"), F.when(i % 4 == 0, F.concat(F.lit("d"), i.cast("string"))).alias("data"), F.when(i % 6 == 0, i / 1000.0).alias("lat"), F.when(i % 6 == 1, i / 1000.0).alias("lng"))


def advanced_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.advanced(_moves(spark, sf_dir))


ADVANCED = f"""WITH {V.QUEUE}, m AS (SELECT source_id AS item_id, ats, item_id AS i, {dealt_sql('item_id', changes.STAGES)} AS st FROM qu)
SELECT item_id, arg_max(st, (ats, i)) AS stage, max(ats) AS updated_at, arg_max('d' || i, (ats, i)) FILTER (WHERE i % 4 = 0) AS data, arg_max(i / 1000.0::DOUBLE, (ats, i)) FILTER (WHERE i % 6 = 0) AS lat, arg_max(i / 1000.0::DOUBLE, (ats, i)) FILTER (WHERE i % 6 = 1) AS lng,
  {', '.join(f"max(ats) FILTER (WHERE st = '{s}') AS {n}" for s, names in changes.STAGE_TIMES.items() for n in names)} FROM m GROUP BY item_id"""


def retried_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.queue(spark, sf_dir).filter("failed").select("item_id", (F.col("item_id") % 5).alias("attempts"), F.lit("w").alias("worker"))
    return changes.retried(q, F.concat(F.lit("error "), F.col("item_id").cast("string")))


RETRIED = f"WITH {V.QUEUE} SELECT item_id, item_id % 5 AS attempts, NULL::VARCHAR AS worker, CASE WHEN item_id % 5 >= 3 THEN 'failed' ELSE 'awaiting_enrichment' END AS status, 'error ' || item_id AS last_error FROM qu WHERE failed"


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' entries made on an order's day, looked up by all their orders."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ats"), F.col("o_orderkey").alias("o"))
    cache = o.groupBy("key").agg(F.min("ats").alias("created_at")).select("key", (F.col("created_at") + F.col("key") % 900 * 86400).alias("created_at"), F.lit(1).cast("long").alias("hit_count"), F.lit(None).cast("long").alias("last_hit_at"))
    return changes.cache_after(cache, o.select("key", "ats"), V.NOW - 1000 * 86400)


CACHE = f"""WITH o AS (SELECT o_custkey AS key, epoch(o_orderdate)::BIGINT AS ats FROM orders), c AS (SELECT key, min(ats) + key % 900 * 86400 AS created_at FROM o GROUP BY key),
h AS (SELECT key, count(*) AS n, max(ats) AS last FROM o JOIN c USING (key) WHERE ats >= created_at AND ats < created_at + 180 * 86400 GROUP BY key)
SELECT key, created_at, 1 + coalesce(n, 0) AS hit_count, last AS last_hit_at, created_at + 180 * 86400 AS expires_at FROM c LEFT JOIN h USING (key) WHERE created_at + 180 * 86400 > {V.NOW} - 1000 * 86400"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosted events by creator and persona, with the commitments of attendees of the same number."""
    persona = F.when(F.col("c_custkey") % 2 == 0, "family").otherwise("social")
    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), persona.alias("persona"))
    stats = profiles.filter("profile_id % 3 = 0").select("profile_id", F.lit("social").alias("persona"), F.lit(2).cast("long").alias("rallies_hosted"))
    hosted = changes.persona_counters(V.events(spark, sf_dir).filter("created_by is not null"), profiles, stats)
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), (F.col("l_suppkey") % 3).alias("profile_id"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("ats"), F.col("l_linenumber").alias("change_id"), F.when(F.col("l_linestatus") == "O", "going").otherwise("declined").alias("status"))
    return hosted.join(changes.commitments_made(a), "profile_id", "left")


COUNTERS = f"""WITH {V.EVENTS}, p AS (SELECT c_custkey AS profile_id, CASE WHEN c_custkey % 2 = 0 THEN 'family' ELSE 'social' END AS persona FROM customer),
m AS (SELECT p.profile_id, persona, count(*) AS n FROM ev JOIN p ON p.profile_id = created_by GROUP BY ALL), s AS (SELECT profile_id, 'social' AS persona, 2 AS rallies_hosted FROM p WHERE profile_id % 3 = 0),
c AS (SELECT l_suppkey % 3 AS profile_id, l_linestatus = 'O' AND coalesce(lag(l_linestatus) OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_shipdate, l_linenumber), 'F') <> 'O' AS became FROM lineitem),
k AS (SELECT profile_id, count(*) FILTER (WHERE became) AS events_committed FROM c GROUP BY 1)
SELECT profile_id, persona, coalesce(rallies_hosted, 0) + coalesce(n, 0) AS rallies_hosted, events_committed FROM m FULL JOIN s USING (profile_id, persona) LEFT JOIN k USING (profile_id)"""


def pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records pushed from the stream of events as a change feed: each sign-up awaits enrichment."""
    feed = windows.table_stream(spark, f"{sf_dir}/events.parquet").select(F.col("event_id").alias("item_id"), F.col("user_id").alias("source_id"), F.when(F.col("event_type") == "signup", "awaiting_enrichment").otherwise("done").alias("status"))
    return windows.run_to_end(changes.push_records(feed), "append")


PUSHED = """SELECT event_id AS item_id, '{"type":"INSERT","table":"raw_event_staging","record":{"item_id":' || event_id || ',"source_id":' || user_id || ',"status":"awaiting_enrichment"}}' AS body FROM events WHERE event_type = 'signup'"""


def request_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.queue(spark, sf_dir)
    end = q.agg(F.max("ats")).first()[0]
    return ops.request_statistics(q.select(F.col("source_id").alias("rate_key"), F.when(F.col("k") % 2 == 0, "ip").otherwise("user").alias("key_type"), "ats"), end, 86400)


REQUESTS = f"""WITH {V.QUEUE}, n AS (SELECT max(ats) AS now FROM qu) SELECT source_id AS rate_key, CASE WHEN k % 2 = 0 THEN 'ip' ELSE 'user' END AS key_type, count(*) AS total_requests, max(ats) AS last_request_at, min(ats) AS first_request_at, any_value(now) - max(ats) AS seconds_since
FROM qu, n WHERE ats >= now - 86400 GROUP BY 1, 2"""


def source_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Healthy, quarantined and prioritised sources, with the counts of breakers' states, as one list."""
    s = _sources(spark, sf_dir).withColumn("disabled_reason", F.when(F.col("source_id") % 9 == 0, "health_score_quarantine")).withColumn("state", F.when(F.col("opens") > 5, "OPEN").when(F.col("opens") > 3, "HALF_OPEN").otherwise("CLOSED"))
    row = lambda df, kind: df.select(F.lit(kind).alias("list"), F.col("source_id").cast("string").alias("item"), F.col("health").alias("value"))
    states = s.groupBy("state").agg(F.count(F.lit(1)).alias("value")).select(F.lit("state").alias("list"), F.col("state").alias("item"), "value")
    first = s.filter(F.col("enabled")).select("source_id", (F.col("health") - 5 * F.col("failures")).alias("health")).orderBy(F.desc("health"), "source_id").limit(10)
    return row(ops.healthy_sources(s, 40, None, 50), "healthy").unionByName(row(ops.quarantined_sources(s), "quarantined")).unionByName(row(first, "priority")).unionByName(states)


LISTS = f"""WITH {_SOURCES} SELECT * FROM (SELECT 'healthy' AS list, source_id::VARCHAR AS item, health AS value FROM so WHERE enabled AND health >= 40 ORDER BY tier, health DESC, last_scraped NULLS FIRST, source_id LIMIT 50)
UNION ALL SELECT 'quarantined', source_id::VARCHAR, health FROM so WHERE health < 40 OR source_id % 9 = 0
UNION ALL SELECT * FROM (SELECT 'priority', source_id::VARCHAR, health - 5 * failures AS v FROM so WHERE enabled ORDER BY v DESC, source_id LIMIT 10)
UNION ALL SELECT 'state', CASE WHEN opens > 5 THEN 'OPEN' WHEN opens > 3 THEN 'HALF_OPEN' ELSE 'CLOSED' END, count(*) FROM so GROUP BY 2"""

_BOUNDS = [10.0, 25.0, 50.0, 100.0]


def duration_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 0.95-quantile of values by stage from cumulative buckets."""
    q = V.queue(spark, sf_dir).select("stage", F.explode(F.array(*[F.lit(b) for b in (*_BOUNDS, float("inf"))])).alias("le"), "value")
    buckets = q.groupBy("stage", "le").agg(F.count_if(F.col("value") <= F.col("le")).alias("n"))
    return ops.bucket_quantile(buckets, ["stage"], 0.95).select("stage", F.round("quantile", 6).alias("quantile"))


QUANTILES = f"""WITH {V.QUEUE}, c AS (SELECT stage, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE value <= {b}) AS c{i}' for i, b in enumerate(_BOUNDS))} FROM qu GROUP BY stage), t AS (SELECT *, n * 0.95::DOUBLE AS r FROM c)
SELECT stage, round(CASE {' '.join(f"WHEN c{i} >= r THEN {_BOUNDS[i - 1] if i else 0.0}::DOUBLE + {b - (_BOUNDS[i - 1] if i else 0.0)}::DOUBLE * (r - {f'c{i - 1}' if i else '0'}) / (c{i} - {f'c{i - 1}' if i else '0'})" for i, b in enumerate(_BOUNDS))} ELSE {_BOUNDS[-1]}::DOUBLE END, 6) AS quantile FROM t"""


def monitored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's least value of its source's last ten hours, for the five sources with the most failures, with their highest value."""
    q = V.queue(spark, sf_dir)
    by = q.groupBy("source_id").agg(F.count_if("failed").alias("failures"), F.max("value").alias("most"))
    top = by.orderBy(F.desc("failures"), "source_id").limit(5)
    return ops.trailing_least(q, ["source_id"], "value", 36000).select("item_id", "source_id", "least").join(F.broadcast(top), "source_id")  # five rows by definition


MONITORED = f"""WITH {V.QUEUE}, t AS (SELECT source_id, count(*) FILTER (WHERE failed) AS failures, max(value) AS most FROM qu GROUP BY source_id ORDER BY failures DESC, source_id LIMIT 5)
SELECT item_id, source_id, min(value) OVER (PARTITION BY source_id ORDER BY ats RANGE BETWEEN 36000 PRECEDING AND CURRENT ROW) AS least, failures, most FROM qu JOIN t USING (source_id)"""


def reset_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.queue(spark, sf_dir)
    return ops.reset_and_listed(q, (F.col("stage") == "fetching") & (F.col("k") < 5))


RESET = f"WITH {V.QUEUE} SELECT item_id::VARCHAR AS item_id, count(*) OVER () AS reset_count FROM qu WHERE stage = 'fetching' AND k < 5"

QUERIES = {
    "d13_shown_labels": (shown_labels, LABELS), "d11_opening_hours": (opening_hours, OPENING), "d21_due_jobs": (due_jobs, DUE), "d6_instants": (instants, INSTANTS), "x21_looked_up": (looked_up, LOOKED_UP),
    "v2_padded_vectors": (padded_vectors, PADDED), "f10_missing_places": (missing_places, MISSING), "l3_enqueued_jobs": (enqueued_jobs, ENQUEUED), "l5_requeued_events": (requeued_events, REQUEUED),
    "l7_error_counts": (error_counts, ERROR_COUNTS), "wt5_advanced_items": (advanced_items, ADVANCED), "wt10_retried_items": (retried_items, RETRIED), "wt14_cache_hits": (cache_hits, CACHE), "wt16_counters": (counters, COUNTERS),
    "wt15_pushed_records": (pushed, PUSHED), "a14_request_statistics": (request_statistics, REQUESTS), "k16_source_lists": (source_lists, LISTS), "a31_duration_quantiles": (duration_quantiles, QUANTILES),
    "a31_monitored": (monitored, MONITORED), "a13_reset_list": (reset_list, RESET),
}
