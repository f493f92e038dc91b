"""Queries of streams and state machines, with their SQL where it has a form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.plans import views as V
from larkspan.session import table
from larkspan.streaming import machines, state, windows


def _replayed(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return machines.replay(V.queue(spark, sf_dir), name)

    return query


def stream_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.table_stream(spark, f"{sf_dir}/events.parquet").withColumn("at_time", F.col("ts").cast("timestamp"))
    return windows.run_to_end(windows.tumbling(rows, "at_time", "1 hour", ["event_type"]), "complete")


STREAM_BUCKETS = "SELECT epoch_us(ts) // 1000000 // 3600 * 3600 AS bucket, event_type, count(*) AS items FROM events GROUP BY 1, 2"


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.table_stream(spark, f"{sf_dir}/events.parquet").withColumn("at_time", F.col("ts").cast("timestamp"))
    return windows.run_to_end(windows.sliding(rows, "at_time", "2 hours", "1 hour", ["event_type"]), "complete")


STREAM_SLIDING = """WITH e AS (SELECT event_type, epoch_us(ts) // 1000000 // 3600 * 3600 AS b FROM events), w AS (SELECT event_type, b FROM e UNION ALL SELECT event_type, b - 3600 FROM e)
SELECT b AS bucket, event_type, count(*) AS items FROM w GROUP BY 1, 2"""


def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breaker over the stream's keyed state; equal to its replay over the table."""
    source = windows.table_stream(spark, f"{sf_dir}/events.parquet")
    rows = source.select(F.col("event_id").alias("item_id"), F.col("user_id").alias("source_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ats"), (F.col("event_type") == "error").alias("failed"))
    return windows.run_to_end(state.stream_machine(rows, machines.MACHINES["breaker"]), "append")


def _streamed(name: str):
    """The machine over the table's files as a stream; equal to its replay over the table."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = windows.table_stream(spark, f"{sf_dir}/events.parquet")
        return windows.run_to_end(state.stream_machine(V.queue_of(source), machines.MACHINES[name]), "append")

    return query


def _cache_actions(rows: DataFrame) -> DataFrame:
    """The stream of events as a cache's actions: each user's first sign-up makes the entry, all other events look it up."""
    at = F.col("ts").cast("timestamp")
    return rows.select(F.col("user_id").alias("key"), F.unix_seconds(at).alias("ats"), F.when(F.col("event_type") == "signup", "put").otherwise("hit").alias("kind"), at.alias("at"))


def stream_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's entry as the stream leaves it: the row that was shown last, alive or expired."""
    shown = windows.run_to_end(state.cached(_cache_actions(windows.table_stream(spark, f"{sf_dir}/events.parquet")), days=3), "append")
    return shown.groupBy("key", "created_at").agg(F.max_by(F.struct("hit_count", "last_hit_at", "expires_at"), F.struct("hit_count", ~F.col("alive"))).alias("e")).select("key", "created_at", "e.*")


STREAM_CACHE = """WITH a AS (SELECT user_id AS key, epoch_us(ts) // 1000000 AS ats, event_type = 'signup' AS put FROM events),
c AS (SELECT key, min(ats) AS created_at FROM a WHERE put GROUP BY key)
SELECT key, created_at, (1 + count(a.ats))::BIGINT AS hit_count, max(a.ats) AS last_hit_at, created_at + 3 * 86400 AS expires_at
FROM c LEFT JOIN a USING (key) WHERE NOT coalesce(a.put, false) AND (a.ats IS NULL OR (a.ats >= created_at AND a.ats < created_at + 3 * 86400)) GROUP BY key, created_at
UNION ALL SELECT key, created_at, 1, NULL, created_at + 3 * 86400 FROM c
WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.key = c.key AND NOT a.put AND a.ats >= created_at AND a.ats < created_at + 3 * 86400)"""


def _changes(rows: DataFrame) -> DataFrame:
    """The stream of events as a change feed: a user's status is the kind of the last event."""
    status = F.when(F.col("event_type") == "signup", "awaiting_enrichment").otherwise(F.col("event_type"))
    return rows.select(F.col("user_id").alias("item_id"), F.col("event_id").alias("change_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ats"), status.alias("status"))


def stream_pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.run_to_end(state.entered(_changes(windows.table_stream(spark, f"{sf_dir}/events.parquet"))), "append")
    return found.select("item_id", "change_id", state.push_body(found, ["item_id", "status"]).alias("body"))


def table_pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = state.entered(_changes(table(spark, sf_dir, "events")))
    return found.select("item_id", "change_id", state.push_body(found, ["item_id", "status"]).alias("body"))


PUSHES = """WITH c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS before FROM events)
SELECT user_id AS item_id, event_id AS change_id, '{"type":"INSERT","table":"raw_event_staging","schema":"public","record":{"item_id":' || user_id || ',"status":"awaiting_enrichment"},"old_record":null}' AS body
FROM c WHERE event_type = 'signup' AND before IS DISTINCT FROM 'signup'"""


def _stepped(state: str, step: str, output: str) -> str:
    """SQL of a machine: all sources take their next row together. state and step: columns; output: what each row shows."""
    names = [c.rsplit(" AS ", 1)[1] for c in state.split("; ")]
    nexts = ", ".join(f"{e} AS {n}" for e, n in zip(step.split("; "), names, strict=True))
    return f"""WITH RECURSIVE {V.QUEUE}, o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ats, item_id) AS n FROM qu),
r AS (SELECT source_id, 0::BIGINT AS n, NULL::BIGINT AS item_id, {state.replace("; ", ", ")} FROM (SELECT DISTINCT source_id FROM qu)
UNION ALL SELECT o.source_id, o.n, o.item_id, {nexts} FROM r JOIN o ON o.source_id = r.source_id AND o.n = r.n + 1)
SELECT item_id, source_id, {output} FROM r WHERE n > 0"""


_FRESH = f"(r.start IS NULL OR o.ats - r.start > {machines.RATE_SECONDS})"
_USED = f"(CASE WHEN {_FRESH} THEN 0 ELSE r.used END)"
_START = f"(CASE WHEN {_FRESH} THEN o.ats ELSE r.start END)"
RATE_WINDOWS = _stepped(
    "NULL::BIGINT AS start; 0::BIGINT AS used; true AS allowed; 0::BIGINT AS wait_ms",
    f"{_START}; least({_USED} + 1, {machines.RATE_MOST}); {_USED} < {machines.RATE_MOST}; CASE WHEN {_USED} < {machines.RATE_MOST} THEN 0 ELSE ({_START} + {machines.RATE_SECONDS} - o.ats) * 1000 END",
    "start AS window_start, allowed, wait_ms",
)
_NOW = "(CASE WHEN r.name = 'OPEN' AND r.til <= o.ats THEN 'HALF_OPEN' ELSE r.name END)"
_OPENS = f"(o.failed AND {_NOW} <> 'OPEN' AND r.failures >= 4)"
BREAKER = _stepped(
    "'CLOSED' AS name; 0::BIGINT AS failures; 0::BIGINT AS opens; 0::BIGINT AS til",
    f"CASE WHEN NOT o.failed THEN 'CLOSED' WHEN {_OPENS} THEN 'OPEN' ELSE {_NOW} END; CASE WHEN o.failed THEN r.failures + 1 ELSE 0 END; CASE WHEN NOT o.failed THEN 0 WHEN {_OPENS} THEN r.opens + 1 ELSE r.opens END; "
    f"CASE WHEN NOT o.failed THEN 0 WHEN {_OPENS} THEN o.ats + least(1800 * pow(2, r.opens), 86400)::BIGINT ELSE r.til END",
    "name AS breaker, failures, opens",
)
_EMPTY = f"(CASE WHEN o.value >= {machines.EMPTY_BELOW} THEN 0 ELSE r.empties + 1 END)"
_UP = f"({_EMPTY} >= 3 AND r.level < 2)"
ESCALATION = _stepped("0::BIGINT AS level; 0::BIGINT AS empties", f"CASE WHEN {_UP} THEN r.level + 1 ELSE r.level END; CASE WHEN {_UP} THEN 0 ELSE {_EMPTY} END", "['static', 'puppeteer', 'scrapingbee'][level + 1] AS fetcher, empties AS empty_pages")
_AFTER = "greatest(0, least(100, r.health + CASE WHEN o.failed THEN -20 WHEN o.stage = 'indexed' THEN 10 ELSE 2 END))"
SOURCE_HEALTH = _stepped("70::BIGINT AS health; true AS enabled", f"{_AFTER}; CASE WHEN {_AFTER} < 40 THEN false WHEN r.health < 40 AND {_AFTER} >= 50 THEN true ELSE r.enabled END", "health, enabled")

#: A breaker opens at five failures since the last success; how many in a row there are needs no state.
FAILURES = f"""WITH {V.QUEUE},
g AS (SELECT *, count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY source_id ORDER BY ats, item_id ROWS UNBOUNDED PRECEDING) AS g FROM qu),
r AS (SELECT *, count(*) FILTER (WHERE failed) OVER (PARTITION BY source_id, g ORDER BY ats, item_id ROWS UNBOUNDED PRECEDING) AS run,
  count(*) FILTER (WHERE failed) OVER (PARTITION BY source_id ORDER BY ats, item_id ROWS UNBOUNDED PRECEDING) AS all_failed FROM g)
SELECT item_id, source_id, run AS failures_in_a_row, max(run >= 6) OVER (PARTITION BY source_id ORDER BY ats, item_id ROWS UNBOUNDED PRECEDING) AS quarantined, greatest(0, 100 - 5 * all_failed) AS reliability_hundredths FROM r"""

QUERIES = {
    "wt1_rate_windows": (_replayed("rate_window"), RATE_WINDOWS), "wt8_circuit_breaker": (_replayed("breaker"), BREAKER), "wt11_fetcher_escalation": (_replayed("escalation"), ESCALATION),
    "wt12_source_health": (_replayed("health"), SOURCE_HEALTH), "wt7_source_failures": (_replayed("failures"), FAILURES), "wt3_stream_buckets": (stream_buckets, STREAM_BUCKETS),
    "wt2_stream_sliding": (stream_sliding, STREAM_SLIDING), "wt8_stream_breaker": (stream_breaker, BREAKER),
    "wt1_stream_rate_windows": (_streamed("rate_window"), RATE_WINDOWS), "wt11_stream_escalation": (_streamed("escalation"), ESCALATION), "wt12_stream_health": (_streamed("health"), SOURCE_HEALTH),
    "wt14_stream_cache": (stream_cache, STREAM_CACHE), "wt15_stream_pushes": (stream_pushes, PUSHES), "wt15_entered": (table_pushes, PUSHES),
}
