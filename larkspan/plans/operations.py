"""Queries of operations analytics, duplicates and writes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import scoring
from larkspan.operators import changes, dedup, ops
from larkspan.plans import views as V
from larkspan.session import table

NOW = 1706745600  # 2024-02-01, after the last of the event stream
_Q = f"WITH {V.QUEUE}"
_R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


def daily_source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _R6(ops.daily_source_stats(V.queue(spark, sf_dir)), "success_rate", "mean_value")


DAILY = f"""{_Q}
SELECT ats // 86400 AS day, source_id, count(*) AS items, count(*) FILTER (WHERE stage = 'indexed') AS indexed, count(*) FILTER (WHERE failed) AS failed,
  round(count(*) FILTER (WHERE stage = 'indexed') / nullif(count(*) FILTER (WHERE stage IN ('indexed', 'failed')), 0), 6) AS success_rate, round(avg(value), 6) AS mean_value
FROM qu GROUP BY 1, 2"""


def stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _R6(ops.stage_stats(V.queue(spark, sf_dir), NOW), "mean_wait_minutes")


STAGE = f"""{_Q}
SELECT stage, count(*) AS items, min(ats) AS oldest, round(avg(({NOW} - ats) / 60), 6) AS mean_wait_minutes,
  list_position(['discovered', 'fetching', 'extracting', 'indexed', 'failed'], stage) AS place FROM qu WHERE stage <> 'indexed' GROUP BY stage"""


def queue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.queue_metrics(V.queue(spark, sf_dir))


METRICS = f"""{_Q},
c AS (SELECT count(*) FILTER (WHERE stage = 'discovered') AS discovered, count(*) FILTER (WHERE stage = 'fetching') AS fetching, count(*) FILTER (WHERE stage = 'extracting') AS extracting,
  count(*) FILTER (WHERE stage = 'indexed') AS indexed, count(*) FILTER (WHERE stage = 'failed') AS failed, count(*) AS total FROM qu)
SELECT discovered, fetching, extracting, indexed, failed, format('{{{{"discovered":{{}},"fetching":{{}},"extracting":{{}},"indexed":{{}},"failed":{{}},"total":{{}}}}}}', discovered, fetching, extracting, indexed, failed, total) AS as_json FROM c"""


def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _R6(ops.run_statistics(V.queue(spark, sf_dir), NOW, 14), "mean_value")


RUNS = f"""{_Q}
SELECT strategy, count(*) AS runs, count(*) FILTER (WHERE failed) AS failures, round(count(*) FILTER (WHERE NOT failed) * 100.0::DOUBLE / count(*), 2) AS success_rate, round(avg(value), 6) AS mean_value
FROM qu WHERE ats >= {NOW - 14 * 86400} GROUP BY strategy"""


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _R6(ops.reliability(V.queue(spark, sf_dir)), "reliability")


RELIABILITY = f"""{_Q}, n AS (SELECT source_id, count(*) FILTER (WHERE stage = 'indexed') AS engaged, count(*) FILTER (WHERE stage <> 'discovered') AS committed FROM qu GROUP BY source_id)
SELECT source_id, engaged, committed, round(CASE WHEN committed = 0 THEN 100.0 ELSE least(greatest(engaged * 100.0::DOUBLE / committed, 0.0), 100.0) END, 6) AS reliability FROM n"""


def last_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.last_average(V.queue(spark, sf_dir))


LAST = f"""{_Q}, n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ats DESC, item_id DESC) AS n FROM qu WHERE NOT failed AND value > 0)
SELECT source_id, round(avg(value))::BIGINT AS last_average FROM n WHERE n <= 5 GROUP BY source_id"""


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.queue(spark, sf_dir)
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"))
    return _R6(ops.source_health(sources, q, NOW), "mean_value")


HEALTH = f"""{_Q},
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ats DESC, item_id DESC) AS n FROM qu) WHERE n = 1),
r AS (SELECT * FROM qu WHERE ats >= {NOW - 30 * 86400}),
s AS (SELECT source_id, count(*) AS items, count(*) FILTER (WHERE failed) AS failures, avg(value) AS mean_value FROM r GROUP BY source_id),
m AS (SELECT source_id, strategy, row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, strategy) AS n FROM r GROUP BY source_id, strategy)
SELECT s_suppkey AS source_id, s_name AS name, l.stage AS last_stage, l.ats AS last_at, items, failures, round(mean_value, 6) AS mean_value, m.strategy
FROM supplier LEFT JOIN l ON l.source_id = s_suppkey LEFT JOIN s ON s.source_id = s_suppkey LEFT JOIN m ON m.source_id = s_suppkey AND m.n = 1"""


def trailing_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.trailing_requests(V.queue(spark, sf_dir), 36000, 4).select("item_id", "in_window", "allowed")


TRAILING = f"""{_Q}, w AS (SELECT item_id, count(*) OVER (PARTITION BY source_id ORDER BY ats RANGE BETWEEN 36000 PRECEDING AND CURRENT ROW) AS in_window FROM qu)
SELECT item_id, in_window, in_window < 4 AS allowed FROM w"""


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.promotions(V.queue(spark, sf_dir), NOW)


PROMOTIONS = f"""{_Q} SELECT source_id, strategy, count(*) AS wins FROM qu WHERE NOT failed AND ats >= {NOW - 7 * 86400} GROUP BY ALL HAVING count(*) >= 3"""


def grouped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.grouped_counts(V.queue(spark, sf_dir)).select("stage", "strategy", F.col("failed").cast("string").alias("failed"), "items")


GROUPED = f"""{_Q} SELECT stage, strategy, failed::VARCHAR AS failed, count(*) AS items FROM qu GROUP BY GROUPING SETS ((stage), (strategy), (failed))"""


def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.share_of_total(V.queue(spark, sf_dir), "stage")


SHARE = f"""{_Q} SELECT stage, count(*) AS items, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percentage FROM qu GROUP BY stage"""


def failure_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.failure_run(V.queue(spark, sf_dir))


FAILURE_RUN = f"""{_Q}, n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ats DESC, item_id DESC) AS n FROM qu),
f AS (SELECT source_id, n, min(n) FILTER (WHERE NOT failed) OVER (PARTITION BY source_id) AS first_ok FROM n WHERE n <= 5)
SELECT source_id, count(*) FILTER (WHERE n < coalesce(first_ok, 6)) AS failures_in_a_row FROM f GROUP BY source_id"""


def query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _R6(ops.query_metrics(V.queue(spark, sf_dir), 400.0), "mean")


QUERY_METRICS = f"""{_Q} SELECT count(*) AS total, count(*) FILTER (WHERE failed) AS failed, round(avg(value), 6) AS mean, count(*) FILTER (WHERE value > 400) AS slow,
  (SELECT item_id FROM qu ORDER BY value DESC, item_id LIMIT 1) AS slowest FROM qu"""


def discrepancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = V.queue(spark, sf_dir).select(F.col("k").alias("scraped"), (F.col("item_id") % 60).alias("inserted"))
    return ops.discrepancy(jobs)


DISCREPANCY = f"""{_Q} SELECT sum(k)::BIGINT AS scraped, sum(item_id % 60)::BIGINT AS inserted, sum(greatest(0, k - item_id % 60))::BIGINT AS lost FROM qu"""


def interest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.queue(spark, sf_dir)
    action = F.when(F.col("stage") == "discovered", "view").when(F.col("stage") == "fetching", "like").when(F.col("stage") == "indexed", "join").otherwise("other")
    return ops.interest_scores(q.select(F.col("source_id").alias("user_id"), action.alias("action"), F.when(F.col("k") % 3 == 0, "family").when(F.col("k") % 3 == 1, "music").otherwise("foodie").alias("category")))


INTEREST = f"""{_Q}, s AS (SELECT source_id AS user_id, CASE k % 3 WHEN 0 THEN 'family' WHEN 1 THEN 'music' ELSE 'foodie' END AS category,
  sum(CASE stage WHEN 'discovered' THEN 1 WHEN 'fetching' THEN 2 WHEN 'indexed' THEN 3 ELSE 0 END)::BIGINT AS score FROM qu GROUP BY ALL)
SELECT user_id, category, score, max(category = 'family' AND score > 5) OVER (PARTITION BY user_id) AS is_parent FROM s"""


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _R6(ops.percentiles(V.queue(spark, sf_dir), ["stage"], "value"), "p50", "p95", "p99")


PERCENTILES = f"""{_Q} SELECT stage, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM qu GROUP BY stage"""


def counter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _R6(ops.counter_rates(ops.tumbling(V.queue(spark, sf_dir), 3600)), "rate").select("bucket", "stage", "items", "failures", "rate")


RATES = f"""{_Q}, b AS (SELECT ats - ats % 3600 AS bucket, stage, count(*) AS items, count(*) FILTER (WHERE failed) AS failures FROM qu GROUP BY 1, 2)
SELECT bucket, stage, items, failures, round(items::DOUBLE / (bucket - lag(bucket) OVER (PARTITION BY stage ORDER BY bucket)), 6) AS rate FROM b"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("source_id"), (k % 3 + 1).alias("tier"), (k * 7 % 101).alias("health"), F.when(k % 5 != 0, k % 2 == 0).alias("enabled"), (k % 6).alias("failures"), (k * 3 % 17 * 10).alias("events"),
        F.when(k % 4 == 0, k * 1000).alias("cooldown_until"), F.when(k % 7 != 0, k * 31 % 997).alias("last_scraped"), (k % 8).alias("opens"),
    )


_SOURCES = """so AS (SELECT s_suppkey AS source_id, s_suppkey % 3 + 1 AS tier, s_suppkey * 7 % 101 AS health, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 2 = 0 END AS enabled, s_suppkey % 6 AS failures,
  s_suppkey * 3 % 17 * 10 AS events, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey * 1000 END AS cooldown_until, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey * 31 % 997 END AS last_scraped, s_suppkey % 8 AS opens FROM supplier)"""


def available_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.available_sources(_sources(spark, sf_dir), 50_000).limit(20).select("source_id", "tier", "health")


AVAILABLE = f"""WITH {_SOURCES} SELECT source_id, tier, health FROM so WHERE (enabled IS NULL OR enabled) AND failures < 3 AND (cooldown_until IS NULL OR cooldown_until <= 50000)
ORDER BY tier, health DESC, last_scraped NULLS FIRST, source_id LIMIT 20"""


def source_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sources(spark, sf_dir)
    failed, complete = F.col("failures") > 3, F.col("events") > 80
    after = scoring.health_after(F.col("health"), failed, complete, F.col("events") % 20 == 0, F.col("tier") == 1)
    out = s.withColumn("health_after", after).select(
        "source_id", "health_after", scoring.enabled_after(F.col("enabled"), F.col("health"), F.col("health_after")).alias("enabled_after"),
        scoring.source_priority(F.coalesce("last_scraped", F.lit(0)) / 24.0, F.col("events"), F.col("failures")).alias("priority"),
        scoring.backoff_hours(F.col("failures"), F.col("opens")).alias("backoff_hours"), scoring.breaker_cooldown_minutes(F.col("opens")).alias("cooldown_minutes"),
        scoring.retry_hours(F.col("failures")).alias("retry_hours"), scoring.scrape_interval_minutes(F.col("health") / 100.0).alias("interval_minutes"),
        scoring.raised_rate_limit(F.col("events") * 200, F.when(F.col("failures") % 2 == 0, 429).otherwise(200)).alias("rate_limit_ms"), F.round(scoring.decayed(F.col("health") / 100.0), 6).alias("decayed"),
    )
    return out


SOURCE_RULES = f"""WITH {_SOURCES}, h AS (SELECT *, least(greatest(health + CASE WHEN failures > 3 THEN -20 WHEN events > 80 THEN 10 ELSE 2 END
  - CASE WHEN events % 20 = 0 THEN 0 ELSE 5 END - CASE WHEN tier = 1 THEN 0 ELSE 5 END, 0), 100) AS health_after FROM so)
SELECT source_id, health_after, CASE WHEN health_after < 40 THEN false WHEN health < 40 AND health_after >= 50 THEN true ELSE enabled END AS enabled_after,
  (round(coalesce(last_scraped, 0) / 24.0::DOUBLE) + floor(events / 10) - failures * 20)::BIGINT AS priority,
  CASE WHEN failures >= 3 THEN least(pow(2.0, least(opens, 5) + 1), 32.0) ELSE 0.0 END::DOUBLE AS backoff_hours, least(30.0 * pow(2.0, opens), 1440.0)::DOUBLE AS cooldown_minutes,
  pow(2.0, failures)::DOUBLE AS retry_hours, round(1440 - health / 100.0::DOUBLE * 1425)::INT AS interval_minutes,
  CASE WHEN failures % 2 = 0 THEN least(events * 400, 30000) ELSE events * 200 END AS rate_limit_ms, round(greatest(health / 100.0::DOUBLE - 0.05, 0.0), 6) AS decayed FROM h"""


def archive_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.archive_candidates(_sources(spark, sf_dir), 4).select("source_id", "reason")


ARCHIVE = f"""WITH {_SOURCES} SELECT source_id, CASE WHEN events = 0 AND failures > 0 THEN 'never_worked' ELSE 'high_failure' END AS reason FROM so WHERE (events = 0 AND failures > 0) OR failures >= 4"""


def claimed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.queue(spark, sf_dir).withColumns({"failures": F.col("k") % 5, "priority": F.col("k") % 7})
    return changes.claimed(q, "fetching", 25, "w1").filter("now_claimed").select("item_id", "worker")


CLAIMED = f"""{_Q} SELECT item_id, 'w1' AS worker FROM qu WHERE stage = 'fetching' AND k % 5 < 3 ORDER BY k % 7 DESC, ats, item_id LIMIT 25"""


def failure_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("k") % 4 == 0, "systemic").when(F.col("k") % 4 == 1, "repair_failure").otherwise("transient")
    return V.queue(spark, sf_dir).select("item_id", changes.after_failure(F.col("k") % 5, level, F.col("stage")).alias("stage_after"))


TRANSITIONS = f"""{_Q} SELECT item_id, CASE WHEN k % 4 IN (0, 1) OR k % 5 >= 2 THEN 'quarantined' ELSE stage END AS stage_after FROM qu"""


def stale_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.queue(spark, sf_dir).select("item_id", F.when(F.col("stage") == "fetching", "processing").otherwise(F.col("stage")).alias("status"), (F.col("k") % 5).alias("retries"), "ats")
    return changes.stale_reset(q, NOW - 10 * 86400).select("item_id", "status", "retries")


STALE = f"""{_Q}, s AS (SELECT *, stage = 'fetching' AND ats < {NOW - 10 * 86400 - 600} AS stale FROM qu)
SELECT item_id, CASE WHEN stale THEN CASE WHEN k % 5 < 3 THEN 'pending' ELSE 'failed' END WHEN stage = 'fetching' THEN 'processing' ELSE stage END AS status, k % 5 + CASE WHEN stale THEN 1 ELSE 0 END AS retries FROM s"""


def retained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.queue(spark, sf_dir).withColumn("status", F.col("stage"))
    return changes.retained(q, {"indexed": NOW - 10 * 86400, "failed": NOW - 20 * 86400}).groupBy("status").agg(F.count(F.lit(1)).alias("items"), F.min("ats").alias("oldest"))


RETAINED = f"""{_Q} SELECT stage AS status, count(*) AS items, min(ats) AS oldest FROM qu WHERE NOT (stage = 'indexed' AND ats < {NOW - 10 * 86400}) AND NOT (stage = 'failed' AND ats < {NOW - 20 * 86400}) GROUP BY stage"""


def capacity_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.attendees(spark, sf_dir)
    going = a.filter("place = 1").select("event_id", "profile_id")
    asks = a.filter("place > 1 or profile_id % 10 = 0").select("event_id", "profile_id", F.col("joined_at").alias("ats"))
    most = V.events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 4 + 1).alias("most"))
    return changes.join_event(asks, going, most).select("event_id", "profile_id", "status")


CAPACITY = f"""WITH {V.EVENTS},{V.ATTENDEES},
g AS (SELECT DISTINCT event_id, profile_id FROM att WHERE place = 1), t AS (SELECT event_id, count(*) AS taken FROM g GROUP BY 1),
r AS (SELECT event_id, profile_id, min(joined_at) AS ats FROM att WHERE place > 1 OR profile_id % 10 = 0 GROUP BY 1, 2),
n AS (SELECT r.*, row_number() OVER (PARTITION BY r.event_id ORDER BY ats, r.profile_id) + coalesce(taken, 0) AS p FROM r LEFT JOIN t USING (event_id)
      WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.event_id = r.event_id AND g.profile_id = r.profile_id))
SELECT event_id, profile_id, 'exists' AS status FROM r SEMI JOIN g USING (event_id, profile_id)
UNION ALL SELECT event_id, profile_id, CASE WHEN event_id % 3 = 0 OR p <= event_id % 4 + 1 THEN 'ok' ELSE 'waitlist' END FROM n"""


def upserted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir)
    old = e.select("event_id", "title", F.unix_seconds("event_date").alias("version"))
    new = e.filter("event_id % 3 = 0").select((F.col("event_id") + 6).alias("event_id"), F.lit("new").alias("title"), F.unix_seconds("event_date").alias("version"))
    return changes.upsert(old, new, ["event_id"], "version")


UPSERTED = f"""WITH {V.EVENTS}, b AS (SELECT event_id, title, ats AS version, 0 AS f FROM ev UNION ALL SELECT event_id + 6, 'new', ats, 1 FROM ev WHERE event_id % 3 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY version DESC, f DESC) AS n FROM b)
SELECT event_id, title, version FROM n WHERE n = 1"""


def changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    seen = p.select("page_id", F.when(F.col("page_id") % 3 == 0, F.sha2("html", 256)).when(F.col("page_id") % 3 == 1, "other").alias("content_hash"))
    return changes.changed_only(p, seen, "page_id", "html").select("page_id", "content_hash")


CHANGED = "SELECT page_id, sha256(html) AS content_hash FROM pages WHERE page_id % 3 <> 0"


def natural_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of odd number among those of even number."""
    e = V.events(spark, sf_dir).withColumn("source_url", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("https://a.example/"), (F.col("event_id") % 901).cast("string"))))
    return dedup.natural_duplicates(e.filter("event_id % 2 = 1"), e.filter("event_id % 2 = 0")).select("event_id", "duplicate_of")


NATURAL = f"""WITH {V.EVENTS}, x AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN event_id % 901 END AS url FROM ev),
u AS (SELECT url, min(event_id) AS by_url FROM x WHERE event_id % 2 = 0 AND url IS NOT NULL GROUP BY 1),
t AS (SELECT lower(title) AS title, ats // 86400 AS day, min(event_id) AS by_title FROM x WHERE event_id % 2 = 0 GROUP BY 1, 2)
SELECT event_id, coalesce(by_url, by_title) AS duplicate_of FROM x LEFT JOIN u USING (url) LEFT JOIN t ON t.title = lower(x.title) AND day = ats // 86400 WHERE event_id % 2 = 1"""


def fuzzy_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir)
    return dedup.fuzzy_duplicates(e.filter("event_id % 4 = 1"), e.filter("event_id % 4 <> 1")).withColumn("confidence", F.round("confidence", 6))


_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_SIMILAR = "CASE WHEN {0} = {1} THEN 1.0 ELSE (greatest(length({0}), length({1})) - levenshtein({0}, {1})) / greatest(length({0}), length({1}))::DOUBLE END"
FUZZY = f"""WITH {V.EVENTS}, x AS (SELECT event_id, ats, {_NORM.format('title')} AS t, {_NORM.format('venue_name')} AS v FROM ev),
m AS (SELECT a.event_id AS new_id, b.event_id AS known_id, {_SIMILAR.format('a.t', 'b.t')} AS st, {_SIMILAR.format('a.v', 'b.v')} AS sv
  FROM x a JOIN x b ON a.event_id % 4 = 1 AND b.event_id % 4 <> 1 AND b.ats BETWEEN a.ats - 7200 AND a.ats + 7200),
c AS (SELECT *, least(1.0, st + CASE WHEN sv > 0.8 THEN 0.1 ELSE 0.0 END)::DOUBLE AS confidence FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY confidence DESC, known_id) AS n FROM c WHERE confidence >= 0.8)
SELECT new_id, known_id, round(confidence, 6) AS confidence FROM r WHERE n = 1"""


def _agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir)
    start = F.unix_seconds("event_date")
    return e.filter("created_by is not null").select(F.col("created_by").alias("user_id"), "event_id", (start - start % 7).alias("start"), F.when(F.col("event_id") % 3 == 0, start + 86400 * 20).alias("end"))


_AGENDA = f"""{V.EVENTS}, ag AS (SELECT created_by AS user_id, event_id, ats - ats % 7 AS s, CASE WHEN event_id % 3 = 0 THEN ats + 86400 * 20 END AS e FROM ev WHERE created_by IS NOT NULL)"""


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.overlaps(_agenda(spark, sf_dir), "user_id")


OVERLAPS = f"""WITH {_AGENDA}, x AS (SELECT user_id, event_id, s, coalesce(e, s + 7200) AS e FROM ag)
SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM x a JOIN x b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.e AND b.s < a.e"""


def neighbour_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.neighbour_overlaps(_agenda(spark, sf_dir), "user_id").select("user_id", "event_id", "conflicts")


NEIGHBOURS = f"""WITH {_AGENDA} SELECT user_id, event_id, coalesce(lag(coalesce(e, s)) OVER (PARTITION BY user_id ORDER BY s, event_id) > s, false) AS conflicts FROM ag"""


def repeated_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("fingerprint", F.sha2(F.coalesce("text", F.lit("")), 256))
    return dedup.repeated(d, ["fingerprint"])


REPEATED = "SELECT sha256(coalesce(text, '')) AS fingerprint, count(*) AS times FROM documents GROUP BY 1 HAVING count(*) > 1"


def commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attended and created events of each host, attended ones first in a tie, by month; newest three by joining marked."""
    e = V.events(spark, sf_dir).select("event_id", "event_date", "created_by")
    went = V.attendees(spark, sf_dir).filter("status = 'going'").groupBy("profile_id", "event_id").agg(F.max("joined_at").alias("joined_at"))
    attended = went.join(e, "event_id").select("profile_id", "event_id", "event_date", F.lit("attended").alias("role"), "joined_at")
    created = e.filter("created_by is not null").select(F.col("created_by").alias("profile_id"), "event_id", "event_date", F.lit("created").alias("role"), F.lit(None).cast("long").alias("joined_at"))
    both = attended.unionByName(created.join(attended.select("profile_id", "event_id"), ["profile_id", "event_id"], "left_anti"))
    return both.groupBy("profile_id", F.date_format("event_date", "MMMM yyyy").alias("month")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("role") == "attended").alias("attended"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_date", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("event_ids"))


COMMITMENTS = f"""WITH {V.EVENTS},{V.ATTENDEES},
w AS (SELECT DISTINCT profile_id, event_id, 'attended' AS role FROM att WHERE status = 'going'),
c AS (SELECT created_by AS profile_id, event_id, 'created' AS role FROM ev WHERE created_by IS NOT NULL),
b AS (SELECT w.* FROM w JOIN ev USING (event_id) UNION ALL SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.profile_id = c.profile_id AND w.event_id = c.event_id))
SELECT profile_id, strftime(make_timestamp(ats * 1000000), '%B %Y') AS month, count(*) AS events, count(*) FILTER (WHERE role = 'attended') AS attended, string_agg(event_id::VARCHAR, ',' ORDER BY ats, event_id) AS event_ids
FROM b JOIN ev USING (event_id) GROUP BY 1, 2"""


def first_attendees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four people who go to each event."""
    from pyspark.sql import Window

    a = V.attendees(spark, sf_dir).filter("status = 'going'")
    return a.withColumn("rank", F.row_number().over(Window.partitionBy("event_id").orderBy("joined_at", "profile_id", "place"))).filter("rank <= 4").select("event_id", "rank", "profile_id")


FIRST_ATTENDEES = f"""WITH {V.EVENTS},{V.ATTENDEES}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY joined_at, profile_id, place) AS rank FROM att WHERE status = 'going')
SELECT event_id, rank, profile_id FROM r WHERE rank <= 4"""


def log_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several logs in one schema, the newest hundred."""
    q, a = V.queue(spark, sf_dir), V.attendees(spark, sf_dir)
    parts = [
        q.filter("failed").select(F.lit("failure").alias("log"), F.col("item_id").alias("id"), "ats"),
        q.filter("stage = 'indexed'").select(F.lit("indexed").alias("log"), F.col("item_id").alias("id"), "ats"),
        a.filter("status = 'going'").select(F.lit("attendance").alias("log"), (F.col("event_id") * 10 + F.col("place")).alias("id"), (F.col("joined_at") + 788918400).alias("ats")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy(F.desc("ats"), "log", "id").limit(100)


LOG_UNION = f"""WITH {V.EVENTS},{V.ATTENDEES},{V.QUEUE}
SELECT * FROM (SELECT 'failure' AS log, item_id AS id, ats FROM qu WHERE failed UNION ALL SELECT 'indexed', item_id, ats FROM qu WHERE stage = 'indexed'
UNION ALL SELECT 'attendance', event_id * 10 + place, joined_at + 788918400 FROM att WHERE status = 'going') ORDER BY ats DESC, log, id LIMIT 100"""

QUERIES = {
    "a2_daily_source_stats": (daily_source_stats, DAILY), "a3_stage_stats": (stage_stats, STAGE), "a6_queue_metrics": (queue_metrics, METRICS), "a7_run_statistics": (run_statistics, RUNS),
    "a9_reliability": (reliability, RELIABILITY), "a10_last_average": (last_average, LAST), "j7_source_health": (source_health, HEALTH), "wt2_trailing_requests": (trailing_requests, TRAILING),
    "a16_promotions": (promotions, PROMOTIONS), "a17_grouped_counts": (grouped_counts, GROUPED), "n1_share_of_total": (share_of_total, SHARE), "n4_failure_run": (failure_run, FAILURE_RUN),
    "a24_query_metrics": (query_metrics, QUERY_METRICS), "a22_discrepancy": (discrepancy, DISCREPANCY), "a27_interest_scores": (interest_scores, INTEREST), "a30_percentiles": (percentiles, PERCENTILES),
    "a31_counter_rates": (counter_rates, RATES), "k16_available_sources": (available_sources, AVAILABLE), "m18_source_rules": (source_rules, SOURCE_RULES), "k20_archive_candidates": (archive_candidates, ARCHIVE),
    "wt6_claimed_items": (claimed_items, CLAIMED), "wt7_failure_transitions": (failure_transitions, TRANSITIONS), "wt9_stale_items": (stale_items, STALE), "wt13_retained_items": (retained_items, RETAINED),
    "l4_capacity_joins": (capacity_joins, CAPACITY), "s16_upserted_orders": (upserted_orders, UPSERTED), "s17_changed_pages": (changed_pages, CHANGED), "j21_natural_duplicates": (natural_duplicates, NATURAL),
    "j14_fuzzy_duplicates": (fuzzy_duplicates, FUZZY), "j15_overlaps": (overlaps, OVERLAPS), "j16_neighbour_overlaps": (neighbour_overlaps, NEIGHBOURS), "a19_repeated_fingerprints": (repeated_fingerprints, REPEATED),
    "k21_commitments": (commitments, COMMITMENTS), "n9_first_attendees": (first_attendees, FIRST_ATTENDEES), "s20_log_union": (log_union, LOG_UNION),
}
