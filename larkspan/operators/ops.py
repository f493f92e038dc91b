"""Reliability and operations analytics over a work queue: item_id, source_id, ats (epoch seconds), stage, failed, value, strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions import scoring

#: Fixed order of the stages.
STAGES = ("discovered", "fetching", "extracting", "indexed", "failed")
DAY = 86400


def _share(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0))


def daily_source_stats(queue: DataFrame) -> DataFrame:
    """Per day and source: items, indexed and failed ones, success and failure rate, mean value."""
    day = F.floor(F.col("ats") / DAY).cast("long")
    n = F.count(F.lit(1))
    return queue.groupBy(day.alias("day"), "source_id").agg(
        n.alias("items"), F.count_if(F.col("stage") == "indexed").alias("indexed"), F.count_if("failed").alias("failed"),
        _share(F.count_if(F.col("stage") == "indexed"), F.count_if(F.col("stage").isin("indexed", "failed"))).alias("success_rate"), F.avg("value").alias("mean_value"),
    )


def stage_stats(queue: DataFrame, now: int, excluded: tuple[str, ...] = ("indexed",)) -> DataFrame:
    """Per stage: items, the oldest, mean wait in minutes, and the stage's place in the fixed order."""
    place = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    kept = queue.filter(~F.col("stage").isin(*excluded))
    return kept.groupBy("stage").agg(F.count(F.lit(1)).alias("items"), F.min("ats").alias("oldest"), F.avg((F.lit(now) - F.col("ats")) / 60).alias("mean_wait_minutes")).withColumn("place", place)


def queue_metrics(queue: DataFrame) -> DataFrame:
    """One row of conditional counts, and the same as JSON with their total."""
    counts = queue.agg(*[F.count_if(F.col("stage") == s).alias(s) for s in STAGES])
    total = sum((F.col(s) for s in STAGES), F.lit(0))
    return counts.select(*STAGES, F.to_json(F.struct(*STAGES, total.alias("total"))).alias("as_json"))


def run_statistics(queue: DataFrame, now: int, days: int) -> DataFrame:
    """Per strategy over the last days: runs, failures, success rate in percent with two decimals, mean value."""
    recent = queue.filter(F.col("ats") >= now - days * DAY)
    return recent.groupBy("strategy").agg(F.count(F.lit(1)).alias("runs"), F.count_if("failed").alias("failures"), F.round(F.count_if(~F.col("failed")) * 100.0 / F.count(F.lit(1)), 2).alias("success_rate"), F.avg("value").alias("mean_value"))


def reliability(queue: DataFrame) -> DataFrame:
    """Per source the share of items that were engaged with, in percent, 100 without any; and clamped."""
    n = queue.groupBy("source_id").agg(F.count_if(F.col("stage") == "indexed").alias("engaged"), F.count_if(F.col("stage") != "discovered").alias("committed"))
    return n.withColumn("reliability", scoring.reliability(F.col("engaged"), F.col("committed")))


def last_average(queue: DataFrame, k: int = 5) -> DataFrame:
    """Mean value of each source's last k items that didn't fail, as a whole number."""
    newest = Window.partitionBy("source_id").orderBy(F.desc("ats"), F.desc("item_id"))
    kept = queue.filter(~F.col("failed") & (F.col("value") > 0)).withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= k)
    return kept.groupBy("source_id").agg(F.round(F.avg("value")).cast("long").alias("last_average"))


def latest(queue: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key."""
    return queue.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ats"), F.desc("item_id")))).filter("_n = 1").drop("_n")


def mode_of(queue: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The most frequent value of each key, the least of several."""
    counts = queue.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(F.col(column), F.struct(-F.col("_n"), F.col(column))).alias(column), F.max("_n").alias("wins"))


def source_health(sources: DataFrame, queue: DataFrame, now: int, days: int = 30) -> DataFrame:
    """Each source with its newest item and its last days' counts, mean and favourite strategy: aggregates, then left joins."""
    recent = queue.filter(F.col("ats") >= now - days * DAY)
    newest = latest(queue, ["source_id"]).select("source_id", F.col("stage").alias("last_stage"), F.col("ats").alias("last_at"))
    sums = recent.groupBy("source_id").agg(F.count(F.lit(1)).alias("items"), F.count_if("failed").alias("failures"), F.avg("value").alias("mean_value"))
    favourite = mode_of(recent, ["source_id"], "strategy").select("source_id", "strategy")
    return sources.join(newest, "source_id", "left").join(sums, "source_id", "left").join(favourite, "source_id", "left")


def trailing_requests(log: DataFrame, seconds: int, most: int) -> DataFrame:
    """Requests of the same key within the trailing window, this one counted; one is allowed while that is below the most."""
    window = Window.partitionBy("source_id").orderBy("ats").rangeBetween(-seconds, 0)
    return log.withColumn("in_window", F.count(F.lit(1)).over(window)).withColumn("allowed", F.col("in_window") < most)


def promotions(queue: DataFrame, now: int, least: int = 3, days: int = 7) -> DataFrame:
    """Strategies that won at a source `least` times or more in the last days."""
    recent = queue.filter((F.col("ats") >= now - days * DAY) & ~F.col("failed"))
    return recent.groupBy("source_id", "strategy").agg(F.count(F.lit(1)).alias("wins")).filter(F.col("wins") >= least)


def grouped_counts(queue: DataFrame) -> DataFrame:
    """Counts by stage, by strategy and by outcome in one pass over grouping sets."""
    sets = [[F.col("stage")], [F.col("strategy")], [F.col("failed")]]
    return queue.groupingSets(sets, "stage", "strategy", "failed").agg(F.count(F.lit(1)).alias("items"))


def share_of_total(rows: DataFrame, column: str) -> DataFrame:
    """Count and percentage of each value; the total is one row, joined back."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("items"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("items").alias("_all")))).withColumn("percentage", F.round(F.col("items") * 100.0 / F.col("_all"), 2)).drop("_all")  # one row


def failure_run(queue: DataFrame, last: int = 5) -> DataFrame:
    """Length of each source's run of failures at the end, within its last few items."""
    newest = Window.partitionBy("source_id").orderBy(F.desc("ats"), F.desc("item_id"))
    kept = queue.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= last)
    unbroken = F.min(F.col("failed").cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("_run", unbroken).groupBy("source_id").agg(F.sum("_run").alias("failures_in_a_row"))


def query_metrics(log: DataFrame, slow: float) -> DataFrame:
    """One row: queries, failed ones, mean and slow ones, and the slowest's id, the first of several."""
    return log.agg(F.count(F.lit(1)).alias("total"), F.count_if("failed").alias("failed"), F.avg("value").alias("mean"), F.count_if(F.col("value") > slow).alias("slow"), F.min_by("item_id", F.struct(-F.col("value"), F.col("item_id"))).alias("slowest"))


def discrepancy(jobs: DataFrame) -> DataFrame:
    """Sums of scraped and inserted, and of what was lost by job."""
    return jobs.agg(F.sum("scraped").alias("scraped"), F.sum("inserted").alias("inserted"), F.sum(F.greatest(F.lit(0), F.col("scraped") - F.col("inserted"))).alias("lost"))


def interest_scores(actions: DataFrame) -> DataFrame:
    """Per user and category: a view counts 1, a like 2, a join 3; a parent has more than five for family."""
    points = F.when(F.col("action") == "view", 1).when(F.col("action") == "like", 2).when(F.col("action") == "join", 3).otherwise(0)
    scores = actions.groupBy("user_id", "category").agg(F.sum(points).alias("score"))
    return scores.withColumn("is_parent", F.max((F.col("category") == "family") & (F.col("score") > 5)).over(Window.partitionBy("user_id")))


def percentiles(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Median, 95th and 99th percentile: exact, over a map-side count of values."""
    return rows.groupBy(*keys).agg(*[F.percentile(column, F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)])


def tumbling(queue: DataFrame, seconds: int) -> DataFrame:
    """Items and failures by stage in buckets of fixed length."""
    return queue.groupBy((F.col("ats") - F.col("ats") % seconds).alias("bucket"), "stage").agg(F.count(F.lit(1)).alias("items"), F.count_if("failed").alias("failures"))


def counter_rates(buckets: DataFrame) -> DataFrame:
    """Change per second between a stage's buckets, as of a counter; a fall restarts it."""
    order = Window.partitionBy("stage").orderBy("bucket")
    total = F.sum("items").over(order)
    before, at = F.lag("total").over(order), F.lag("bucket").over(order)
    rows = buckets.withColumn("total", total)
    return rows.withColumn("rate", F.when(before.isNotNull(), F.when(F.col("total") >= before, F.col("total") - before).otherwise(F.col("total")) / (F.col("bucket") - at)))


def available_sources(sources: DataFrame, now: int) -> DataFrame:
    """Enabled sources that aren't quarantined or cooling down: tier ascending, health descending, never scraped first."""
    ready = (F.col("enabled").isNull() | F.col("enabled")) & (F.col("failures") < 3) & (F.col("cooldown_until").isNull() | (F.col("cooldown_until") <= now))
    return sources.filter(ready).orderBy(F.asc("tier"), F.desc("health"), F.asc_nulls_first("last_scraped"), "source_id")


def archive_candidates(sources: DataFrame, threshold: int) -> DataFrame:
    """Sources that never worked, or have failed often enough, with the first reason that holds."""
    reason = F.when((F.col("events") == 0) & (F.col("failures") > 0), "never_worked").when(F.col("failures") >= threshold, "high_failure")
    return sources.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def claim(queue: DataFrame, stage: str, limit: int, most_failures: int = 3) -> DataFrame:
    """The next items of a stage: highest priority, then oldest."""
    return queue.filter((F.col("stage") == stage) & (F.col("failures") < most_failures)).orderBy(F.desc("priority"), F.asc("ats"), "item_id").limit(limit)


def request_statistics(log: DataFrame, now: int, seconds: int = 3600) -> DataFrame:
    """Requests of the last hour by key and type: number, first, last and how long ago that was."""
    recent = log.filter(F.col("ats") >= now - seconds).groupBy("rate_key", "key_type")
    return recent.agg(F.count(F.lit(1)).alias("total_requests"), F.max("ats").alias("last_request_at"), F.min("ats").alias("first_request_at"), (F.lit(now) - F.max("ats")).alias("seconds_since"))


def healthy_sources(sources: DataFrame, least: int = 40, tier: int | None = None, limit: int = 50) -> DataFrame:
    """The first enabled sources of enough health: tier ascending, health descending, never scraped first."""
    good = F.coalesce(F.col("enabled"), F.lit(False)) & (F.col("health") >= least)
    good = good & (F.col("tier") == tier) if tier is not None else good
    return sources.filter(good).orderBy(F.asc("tier"), F.desc("health"), F.asc_nulls_first("last_scraped"), "source_id").limit(limit)


def quarantined_sources(sources: DataFrame, below: int = 40) -> DataFrame:
    return sources.filter((F.col("health") < below) | F.coalesce(F.col("disabled_reason") == "health_score_quarantine", F.lit(False)))


def bucket_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """The q-quantile of cumulative histograms (keys, upper bound `le`, `n` up to it), linear within the bucket it falls in.

    The lowest bucket begins at 0; in the open one (`le` infinite) the highest finite bound stands.
    """
    order = Window.partitionBy(*keys).orderBy("le")
    rows = buckets.withColumns({"_low": F.coalesce(F.lag("le").over(order), F.lit(0.0)), "_before": F.coalesce(F.lag("n").over(order), F.lit(0)), "_all": F.max("n").over(Window.partitionBy(*keys))})
    hit = rows.filter((F.col("n") >= F.col("_all") * q) & (F.col("_all") > 0)).groupBy(*keys).agg(F.min(F.struct("le", "_low", "_before", "n", "_all")).alias("_b"))
    b = F.col("_b")
    inside = b["_low"] + (b["le"] - b["_low"]) * (b["_all"] * q - b["_before"]) / F.nullif(b["n"] - b["_before"], F.lit(0))
    return hit.select(*keys, F.when(b["le"] == float("inf"), b["_low"]).otherwise(F.coalesce(inside, b["_low"])).alias("quantile"))


def trailing_least(rows: DataFrame, keys: list[str], column: str, seconds: int) -> DataFrame:
    """The least value of the last seconds up to each row."""
    return rows.withColumn("least", F.min(column).over(Window.partitionBy(*keys).orderBy("ats").rangeBetween(-seconds, 0)))


def reset_and_listed(queue: DataFrame, stale: Column) -> DataFrame:
    """The ids of the items that were reset, as texts, each with their number."""
    gone = queue.filter(stale)
    return gone.select(F.col("item_id").cast("string").alias("item_id"), F.lit(gone.count()).cast("long").alias("reset_count"))
