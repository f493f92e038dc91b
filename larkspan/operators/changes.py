"""Writes as tables: upserts, delta skips, capacity-checked joins and conditional updates give the table after the write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.storage import numbered


def upsert(target: DataFrame, source: DataFrame, keys: list[str], version: str) -> DataFrame:
    """target with source's rows inserted or put in place: of each key the row with the newest version, the source's of equal ones."""
    both = target.withColumn("_from", F.lit(0)).unionByName(source.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    newest = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_from"))
    return both.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "_from")


def insert_new(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target and those of source's rows whose keys it lacks; a key that comes twice is inserted once."""
    fresh = source.join(target.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return target.unionByName(fresh, allowMissingColumns=True)


def deleted(target: DataFrame, keys_gone: DataFrame, keys: list[str]) -> DataFrame:
    """target without the rows of the given keys; null keys match nothing."""
    return target.join(keys_gone.select(*keys).distinct(), keys, "left_anti")


def changed_only(pages: DataFrame, seen: DataFrame, key: str, content: str) -> DataFrame:
    """Pages whose content's hash isn't the last one seen."""
    hashed = pages.withColumn("content_hash", F.sha2(content, 256))
    return hashed.join(seen.select(key, F.col("content_hash").alias("_last")), key, "left").filter(F.col("_last").isNull() | (F.col("_last") != F.col("content_hash"))).drop("_last")


def join_event(requests: DataFrame, going: DataFrame, capacity: DataFrame) -> DataFrame:
    """requests with status: exists for those who go already, ok while there is room in order of arrival, else waitlist.

    requests: event_id, profile_id, ats; going: event_id, profile_id; capacity: event_id, most (null for no bound).
    A person who asks twice is counted once.
    """
    first = requests.groupBy("event_id", "profile_id").agg(F.min("ats").alias("ats"))
    known = going.select("event_id", "profile_id").distinct()
    taken = known.groupBy("event_id").agg(F.count(F.lit(1)).alias("taken"))
    old = first.join(known, ["event_id", "profile_id"], "left_semi").withColumn("status", F.lit("exists"))
    new = first.join(known, ["event_id", "profile_id"], "left_anti").join(taken, "event_id", "left").join(capacity, "event_id", "left")
    place = F.row_number().over(Window.partitionBy("event_id").orderBy("ats", "profile_id")) + F.coalesce("taken", F.lit(0))
    fits = F.col("most").isNull() | (F.col("_place") <= F.col("most"))
    new = new.withColumn("_place", place).withColumn("status", F.when(fits, "ok").otherwise("waitlist")).select("event_id", "profile_id", "ats", "status")
    return old.unionByName(new)


def claimed(queue: DataFrame, stage: str, limit: int, worker: str) -> DataFrame:
    """The queue after a worker's claim: the chosen items carry its name, and the column `now_claimed` tells which they are."""
    from larkspan.operators.ops import claim

    chosen = claim(queue, stage, limit).select("item_id", F.lit(True).alias("now_claimed"))
    return queue.join(chosen, "item_id", "left").withColumn("now_claimed", F.coalesce("now_claimed", F.lit(False))).withColumn("worker", F.when(F.col("now_claimed"), worker))


def after_failure(failures: Column, level: Column, stage: Column) -> Column:
    """An item's stage after a failure, by the count before it: quarantined on the third transient one, or on a graver one."""
    return F.when(((failures >= 2) & (level == "transient")) | level.isin("repair_failure", "systemic"), "quarantined").otherwise(stage)


def stale_reset(queue: DataFrame, now: int, minutes: int = 10, most: int = 3) -> DataFrame:
    """Items that have been processed for too long go back to pending, or fail when they have no retry left."""
    stale = (F.col("status") == "processing") & (F.col("ats") < now - minutes * 60)
    status = F.when(stale & (F.col("retries") < most), "pending").when(stale, "failed").otherwise(F.col("status"))
    return queue.withColumns({"status": status, "retries": F.when(stale, F.col("retries") + 1).otherwise(F.col("retries"))})


def retained(rows: DataFrame, cutoffs: dict[str, int]) -> DataFrame:
    """Rows that aren't older than their status' cutoff; statuses without one stay."""
    old = F.lit(False)
    for status, cutoff in cutoffs.items():
        old = old | ((F.col("status") == status) & (F.col("ats") < cutoff))
    return rows.filter(~old)


def tiers(sources: DataFrame, rules: list[tuple[int, list[str]]]) -> DataFrame:
    """The tier of the last rule one of whose patterns (case-insensitive, % for anything) the URL matches; 3 without any."""
    out = F.lit(3)
    for tier, patterns in rules:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | F.col("url").ilike(p)
        out = F.when(hit, tier).otherwise(out)
    return sources.withColumn("tier", out)


def enqueued(calls: DataFrame, queue: DataFrame, sources: DataFrame, column: str = "jobs") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The jobs of JSON arrays of {source_id, payload, next_scrape_at}; the queue and the sources after them.

    Pending jobs of the same sources go, the new ones come in as pending (jobs that repeat are all inserted); a source's
    next scrape becomes the latest that its jobs name, and stays if they name none.
    """
    one = F.explode(F.from_json(F.col(column), "array<struct<source_id: long, payload: string, next_scrape_at: long>>"))
    jobs = calls.select(one.alias("job")).select("job.source_id", F.coalesce("job.payload", F.lit("{}")).alias("payload"), "job.next_scrape_at")
    named = jobs.groupBy("source_id").agg(F.max("next_scrape_at").alias("_next"))
    pending = F.col("status") == "pending"
    kept = queue.filter(~pending).unionByName(queue.filter(pending).join(named, "source_id", "left_anti"))
    after = kept.unionByName(jobs.select("source_id", F.lit("pending").alias("status"), "payload"), allowMissingColumns=True)
    moved = sources.join(named, "source_id", "left").withColumn("next_scrape_at", F.coalesce("_next", "next_scrape_at")).drop("_next")
    return jobs, after, moved


def requeued(events: DataFrame, staging: DataFrame, now: int) -> DataFrame:
    """The staging table after coming events without an image were asked for again: known URLs become pending, new ones are added."""
    poor = events.filter((F.col("image_url").isNull() | (F.col("image_url") == "")) & F.col("source_url").isNotNull() & (F.col("ats") >= now))
    asked = poor.groupBy("source_url").agg(F.min("source_id").alias("_source"), F.lit(True).alias("_again"))
    both = staging.join(asked, "source_url", "full")
    again = F.coalesce("_again", F.lit(False))
    return both.select(
        "source_url", F.coalesce("source_id", "_source").alias("source_id"), F.when(again, "pending").otherwise(F.col("status")).alias("status"),
        F.coalesce("parsing_method", F.lit("ai")).alias("parsing_method"), F.when(again, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def counted_errors(sources: DataFrame, failed: DataFrame, worked: DataFrame) -> DataFrame:
    """Sources with one more error in a row where they are among `failed`, and none where among `worked`, which is applied last."""
    marked = sources.join(failed.select("source_id", F.lit(1).alias("_failed")).distinct(), "source_id", "left").join(worked.select("source_id", F.lit(1).alias("_worked")).distinct(), "source_id", "left")
    return marked.withColumn("errors", F.when(F.col("_worked").isNotNull(), 0).otherwise(F.col("errors") + F.coalesce("_failed", F.lit(0)))).drop("_failed", "_worked")


#: The stages of an item, and the time that entering a stage sets.
STAGES = "discovered analyzing awaiting_fetch fetching cleaning extracting validating enriching deduplicating ready_to_persist vectorizing indexed geo_incomplete quarantined failed".split()
STAGE_TIMES = {"awaiting_fetch": ("analyzed_at",), "cleaning": ("fetched_at",), "validating": ("extracted_at",), "enriching": ("validated_at",), "deduplicating": ("enriched_at",), "indexed": ("vectorized_at", "persisted_at")}


def advanced(moves: DataFrame) -> DataFrame:
    """Items after all their moves (item_id, ats, move_id, next_stage, data, lat, lng): stage, latest data and place, and times of stages.

    A fold by aggregates: the stage of the last move, the last value given of each fact, the last entry of each stage.
    Moves to a stage that there is not are errors.
    """
    order = F.struct("ats", "move_id")
    known = moves.filter(F.coalesce(F.col("next_stage").isin(*STAGES), F.lit(False)) | F.raise_error(F.concat(F.lit("no stage "), F.coalesce("next_stage", F.lit("null")))).isNull())
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    times = [F.max(F.when(F.col("next_stage") == stage, F.col("ats"))).alias(name) for stage, names in STAGE_TIMES.items() for name in names]
    return known.groupBy("item_id").agg(F.max_by("next_stage", order).alias("stage"), F.max("ats").alias("updated_at"), last("data"), last("lat"), last("lng"), *times)


def retried(items: DataFrame, error: Column, most: int = 3) -> DataFrame:
    """Items after a failure: failed for good from the third attempt on, else waiting again; no worker holds them."""
    status = F.when(F.col("attempts") >= most, "failed").otherwise("awaiting_enrichment")
    return items.withColumns({"status": status, "last_error": error, "worker": F.lit(None).cast("string")})


def cache_after(cache: DataFrame, hits: DataFrame, now: int, days: int = 180) -> DataFrame:
    """A cache's live entries after look-ups (key, ats): each that found its entry alive adds to hit_count and sets last_hit_at."""
    alive = cache.withColumn("expires_at", F.col("created_at") + days * 86400)
    met = hits.join(alive.select("key", "created_at", "expires_at"), "key").filter((F.col("ats") >= F.col("created_at")) & (F.col("ats") < F.col("expires_at")))
    found = met.groupBy("key").agg(F.count(F.lit(1)).alias("_hits"), F.max("ats").alias("_last"))
    return alive.filter(F.col("expires_at") > now).join(found, "key", "left").withColumns({"hit_count": F.col("hit_count") + F.coalesce("_hits", F.lit(0)), "last_hit_at": F.greatest("last_hit_at", "_last")}).drop("_hits", "_last")


def persona_counters(events: DataFrame, profiles: DataFrame, stats: DataFrame) -> DataFrame:
    """(profile_id, persona, rallies_hosted) after events: each adds one to its creator's present persona; others stay."""
    made = events.groupBy(F.col("created_by").alias("profile_id")).agg(F.count(F.lit(1)).alias("_made")).join(profiles, "profile_id").select("profile_id", "persona", "_made")
    both = stats.join(made, ["profile_id", "persona"], "full")
    return both.select("profile_id", "persona", (F.coalesce("rallies_hosted", F.lit(0)) + F.coalesce("_made", F.lit(0))).alias("rallies_hosted"))


def commitments_made(changes: DataFrame) -> DataFrame:
    """(profile_id, events_committed): how often an attendance (event_id, profile_id, ats, status) became `going` without being it before."""
    before = F.lag("status").over(Window.partitionBy("event_id", "profile_id").orderBy("ats", "change_id"))
    became = changes.withColumn("_became", (F.col("status") == "going") & (before.isNull() | (before != "going")))
    return became.groupBy("profile_id").agg(F.count_if("_became").alias("events_committed"))


def push_records(rows: DataFrame, status: str = "awaiting_enrichment") -> DataFrame:
    """item_id and the JSON record that is pushed for each row of a change feed that has the status; works on streams too."""
    record = F.struct(F.lit("INSERT").alias("type"), F.lit("raw_event_staging").alias("table"), F.struct(*[F.col(c) for c in rows.columns]).alias("record"))
    return rows.filter(F.col("status") == status).select("item_id", F.to_json(record).alias("body"))


def keyed_union(lists: list[DataFrame], key: str, place: str) -> DataFrame:
    """Lists one after another as a map by key: the last row of a key stands, at the position of its first; place counts from 1.

    place orders each list; rows of a list that share a key count in that order too.
    """
    both = reduce(DataFrame.unionByName, [rows.withColumn("_list", F.lit(i)) for i, rows in enumerate(lists)])
    at = F.struct("_list", place)
    row = F.struct(*[F.col(c) for c in lists[0].columns if c != place])
    kept = both.groupBy(F.col(key).alias("_key")).agg(F.min(at).alias("_at"), F.max_by(row, at).alias("_row"))
    return numbered(kept, [F.col("_at")], "_n").select("_row.*", (F.col("_n") + 1).alias(place))


def marked_duplicates(items: DataFrame, known: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """items with duplicate_of, stage and last_failure_reason: those whose content one indexed row of known has are failed.

    A hash that several indexed rows hold names no row, and null hashes meet none. The indexed rows are counted by hash
    before the join, so that copies don't multiply.
    """
    one = known.filter((F.col("stage") == "indexed") & F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min("item_id").alias("_item"), F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    met = items.join(one.select(F.col(hash_col).alias("_hash"), "_item"), F.col(hash_col) == F.col("_hash"), "left")
    is_copy = F.col("_item").isNotNull() & (F.col("_item") != F.col("item_id"))
    return met.withColumns({"duplicate_of": F.when(is_copy, F.col("_item")), "stage": F.when(is_copy, "failed").otherwise(F.col("stage")), "last_failure_reason": F.when(is_copy, "Duplicate detected")}).drop("_hash", "_item")
