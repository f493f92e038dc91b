"""Duplicate events: natural keys, and titles alike within a time window."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.text import fuzzy_confidence, normal_title, similarity
from larkspan.storage import written


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; the others are duplicates."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def natural_duplicates(new: DataFrame, known: DataFrame) -> DataFrame:
    """new with duplicate_of: by source_url, else by lower-case title on the same day. Two equi-joins on first keys."""
    by_url = first_of(known.filter(F.col("source_url").isNotNull()), ["source_url"], ["event_id"]).select("source_url", F.col("event_id").alias("_by_url"))
    keyed = known.withColumns({"_title": F.lower("title"), "_day": F.to_date("event_date")})
    by_title = first_of(keyed, ["_title", "_day"], ["event_id"]).select("_title", "_day", F.col("event_id").alias("_by_title"))
    out = new.join(by_url, "source_url", "left").withColumns({"_title": F.lower("title"), "_day": F.to_date("event_date")}).join(by_title, ["_title", "_day"], "left")
    return out.withColumn("duplicate_of", F.coalesce("_by_url", "_by_title")).drop("_by_url", "_by_title", "_title", "_day")


def _fewest(size: Column, edits: float) -> Column:
    """How many edits a title may differ by from one of at most `size` characters."""
    return F.floor(size * F.lit(edits) + F.lit(1e-9)).cast("int")


def _segment(size: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of part i when `size` characters are cut into `parts` as equal as can be."""
    base, long = F.floor(size / parts).cast("int"), F.pmod(size, parts)
    return i * base + F.greatest(F.lit(0), i - (parts - long)), base + (i >= parts - long).cast("int")


def title_segments(title: Column, edits: float) -> Column:
    """Keys of a known title: the title cut into d + 1 parts, for each number of edits d that a partner's length allows."""
    size = F.length(title)
    longest = F.floor(size / F.lit(1 - edits) + F.lit(1e-9)).cast("int")

    def cut(d: Column) -> Column:
        def key(i: Column) -> Column:
            start, length = _segment(size, d + 1, i)
            return F.xxhash64(size, d, i, F.substring(title, start + 1, length))

        return F.transform(F.sequence(F.lit(0), d), key)

    return F.flatten(F.transform(F.sequence(_fewest(size, edits), _fewest(longest, edits)), cut))


def title_probes(title: Column, edits: float) -> Column:
    """Keys under which a known title within the allowed edits must stand: one of its d + 1 parts is left unchanged.

    For each length that a partner may have, part i can have moved by i places at most, or, seen from the end, by what
    is left of the edits; only substrings that begin there are keys.
    """
    own = F.length(title)
    shortest, longest = F.ceil(own * F.lit(1 - edits) - F.lit(1e-9)).cast("int"), F.floor(own / F.lit(1 - edits) + F.lit(1e-9)).cast("int")

    def of_length(size: Column) -> Column:
        d, shift = _fewest(F.greatest(own, size), edits), own - size

        def of_part(i: Column) -> Column:
            start, length = _segment(size, d + 1, i)
            low = F.greatest(F.lit(0), start - i, start + shift - (d - i))
            high = F.least(own - length, start + i, start + shift + (d - i))
            places = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda at: F.xxhash64(size, d, i, F.substring(title, at + 1, length)))

        return F.flatten(F.transform(F.sequence(F.lit(0), d), of_part))

    return F.array_distinct(F.flatten(F.transform(F.sequence(shortest, longest), of_length)))


#: Titles of a key up to which each new title meets them all. A segment index looks up about as many parts for a title.
FEW_TITLES = 400
#: Keys that are broadcast at most.
BROADCAST_KEYS = 50_000


def similar_titles(new: DataFrame, known: DataFrame, keys: list[str], least: float, few: int = FEW_TITLES) -> DataFrame:
    """(keys, new_title, known_title, alike) for titles of new and known (keys, title; distinct) of similarity `least` or more.

    Where a key has up to `few` known titles, new ones meet them all. Beyond that titles meet by a segment index, only
    where they share an unchanged part, so a hot key brings no more together than looks alike. Both ways find the same
    pairs; each pair is verified once by its edit distance.
    """
    edits = 1 - least
    hot = written(known.groupBy(*keys).count().filter(F.col("count") > few).drop("count"), "hot")
    n = hot.limit(BROADCAST_KEYS + 1).count()
    hot = F.broadcast(hot) if n <= BROADCAST_KEYS else hot
    part = lambda rows, how: rows.join(hot, keys, how) if n else rows
    held, asked = (rows.withColumnRenamed("title", name) for rows, name in ((known, "known_title"), (new, "new_title")))
    short, long = F.least(F.length("new_title"), F.length("known_title")), F.greatest(F.length("new_title"), F.length("known_title"))
    met = part(asked, "left_anti").join(part(held, "left_anti"), keys).filter(short >= F.lit(least - 1e-9) * long)
    if n:
        parts = part(held, "left_semi").withColumn("_key", F.explode(F.array_distinct(title_segments(F.col("known_title"), edits))))
        probes = part(asked, "left_semi").withColumn("_key", F.explode(title_probes(F.col("new_title"), edits)))
        met = met.unionByName(probes.join(parts, [*keys, "_key"]).select(*met.columns).distinct())
    return met.withColumn("alike", similarity(F.col("new_title"), F.col("known_title"))).filter(F.col("alike") >= least - 1e-9)


def fuzzy_duplicates(new: DataFrame, known: DataFrame, hours: int = 2, least: float = 0.8, few: int = FEW_TITLES) -> DataFrame:
    """The best known event for each new one whose time is within `hours` and whose confidence reaches `least`.

    Confidence is the titles' similarity by edit distance, and a tenth more where the venues are alike. Events that
    agree in title, venue and time are one key, with the two least ids, so copies don't multiply. An interval join as an
    equi-join: time is cut into buckets as long as the window is wide, and within a bucket different titles meet, in a
    full one by the segment index. What similar titles bring together is tested for time and venue. A key keeps its two best, as one of
    them may be the event itself; ties go to the smaller id. Events without a title have no duplicates.
    """
    width = 2 * hours * 3600

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.select("event_id", normal_title(F.col("title")).alias("title"), normal_title(F.col("venue_name")).alias("venue"), F.unix_seconds("event_date").alias("at")).filter("title IS NOT NULL AND at IS NOT NULL")

    key, own = ["title", "venue", "at"], written(keyed(new), "new")
    asked = own.select(*key).distinct()
    asked = asked.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("at") - hours * 3600) / width), F.floor((F.col("at") + hours * 3600) / width))))
    least_two = F.dense_rank().over(Window.partitionBy(*key).orderBy("event_id"))
    held = keyed(known).withColumn("_n", least_two).filter("_n <= 2").groupBy(*key).agg(F.min("event_id").alias("id1"), F.max(F.when(F.col("_n") == 2, F.col("event_id"))).alias("id2"))
    held = written(held.withColumn("bucket", F.floor(F.col("at") / width)), "known")
    titles = similar_titles(asked.select("bucket", "title").distinct(), held.select("bucket", "title").distinct(), ["bucket"], least - 0.1, few)
    left = asked.select("bucket", F.col("title").alias("new_title"), F.col("venue").alias("new_venue"), F.col("at").alias("new_at")).join(titles, ["bucket", "new_title"])
    right = held.select("bucket", F.col("title").alias("known_title"), F.col("venue").alias("known_venue"), F.col("at").alias("known_at"), F.filter(F.array("id1", "id2"), lambda i: i.isNotNull()).alias("ids"))
    met = left.join(right, ["bucket", "known_title"]).filter(F.abs(F.col("new_at") - F.col("known_at")) <= hours * 3600)
    sure = met.withColumn("confidence", fuzzy_confidence(F.col("alike"), similarity(F.col("new_venue"), F.col("known_venue")))).filter(F.col("confidence") >= least)
    each = sure.select("new_title", "new_venue", "new_at", "confidence", F.explode("ids").alias("known_id"))
    place = F.row_number().over(Window.partitionBy("new_title", "new_venue", "new_at").orderBy(F.desc("confidence"), F.asc("known_id")))
    of = lambda n, column: F.max(F.when(F.col("_n") == n, F.col(column)))
    best = each.withColumn("_n", place).filter("_n <= 2").groupBy("new_title", "new_venue", "new_at").agg(*[of(n, c).alias(f"{c}{n}") for n in (1, 2) for c in ("known_id", "confidence")])
    found = own.join(best, (own["title"] == best["new_title"]) & own["venue"].eqNullSafe(best["new_venue"]) & (own["at"] == best["new_at"]))
    itself = F.col("known_id1") == F.col("event_id")
    chosen = found.select(F.col("event_id").alias("new_id"), *[F.when(itself, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(c) for c in ("known_id", "confidence")])
    return chosen.filter("known_id IS NOT NULL")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, a, b) from rows sorted by part, key and start: each of a part's own rows meets the intervals still open."""
    at, still, kind = None, [], None
    keys, firsts, seconds = [], [], []

    def send() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64())], names=["key", "a", "b"])
        for column in (keys, firsts, seconds):
            column.clear()
        return out

    for batch in batches:
        kind = batch.schema.field("key").type
        for part, key, start, end, event, own in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "s", "e", "event_id", "own")), strict=True):
            if (part, key) != at:
                at, still = (part, key), []
            while still and still[0][0] <= start:
                heapq.heappop(still)
            if own:
                met = [other for _, begun, other in still if begun < end and other != event]
                keys += [key] * len(met)
                firsts += [min(event, other) for other in met]
                seconds += [max(event, other) for other in met]
            if end > start:
                heapq.heappush(still, (end, start, event))
            if len(keys) >= 50_000:
                yield send()
    if keys:
        yield send()


def overlaps(events: DataFrame, key: str, hours: float = 2.0, parts: int | None = None) -> DataFrame:
    """All pairs (a < b) of a key's events that overlap; an event without an end lasts `hours`.

    A sweep over the starts, range-partitioned by key and start: an event is in the part of its start, and in each
    later one that it reaches into, where it is open from the beginning. There each start meets what is open. An event
    of ten years costs a row for each part it spans; a key with a third of all events is spread over many parts, and
    memory holds the open events of one key at a time. Events without key or start have no overlaps.
    """
    spark = events.sparkSession
    end = F.coalesce(F.col("end"), F.col("start") + int(hours * 3600))
    timed = events.filter(F.col(key).isNotNull() & F.col("start").isNotNull()).select(F.col(key).alias("key"), "event_id", F.col("start").alias("s"), end.alias("e"))
    kind = timed.schema["key"].dataType.simpleString()
    count = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(timed.repartitionByRange(count, "key", "s").withColumn("part", F.spark_partition_id()), "starts")
    firsts = placed.groupBy("part").agg(F.min(F.struct("key", "s")).alias("first")).collect()  # a row for each part
    bounds = F.broadcast(spark.createDataFrame([(r["part"], *r["first"]) for r in firsts], f"later int, first_key {kind}, first_s bigint"))
    reached = (F.col("first_key") == F.col("key")) & (F.col("later") > F.col("part")) & (F.col("first_s") < F.col("e"))
    carried = placed.join(bounds, reached).select("key", "event_id", "s", "e", F.col("later").alias("part"), F.lit(False).alias("own"))
    whole = placed.withColumn("own", F.lit(True)).unionByName(carried).repartition(count, "part").sortWithinPartitions("part", "key", "s", "own", "event_id")
    return whole.mapInArrow(_sweep, f"key {kind}, a long, b long").withColumnRenamed("key", key)


def neighbour_overlaps(events: DataFrame, key: str) -> DataFrame:
    """Events that begin before the one ahead of them in time has ended; without an end an event has no length."""
    order = Window.partitionBy(key).orderBy("start", "event_id")
    return events.withColumn("conflicts", F.coalesce(F.lag(F.coalesce("end", "start")).over(order) > F.col("start"), F.lit(False)))
