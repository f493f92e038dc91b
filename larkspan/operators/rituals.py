"""Recurring events: keywords, and series at one venue with like titles, weekday and hour; attendance streaks."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.operators.dedup import BROADCAST_KEYS
from larkspan.storage import written

#: Fixed values; they match as substrings.
KEYWORDS = (
    "weekly", "monthly", "every", "recurring", "regular", "club", "meetup", "class", "group", "session",
    "wekelijks", "maandelijks", "elke", "borrel", "ritueel", "training", "les", "groep", "sessie",
)
#: What ends a numbered title.
NUMBER = r"\s*[#\-–]\s*\d+\s*$"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\s+", " ")


def has_keyword(title: Column, description: Column) -> Column:
    both = F.concat(normalised(title), F.lit(" "), normalised(description))
    # An array of one, so that the text is made once, not for each keyword.
    return F.exists(F.array(both), lambda text: reduce(or_, [text.contains(k) for k in KEYWORDS]))


def hour_of(time: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(time, F.lit("")), r"^(\d{1,2}):?", 1), F.lit("")).cast("int")


class _Firsts:
    """The first events of a venue's series, found by title and hour without a look at all of them.

    A title that holds another holds the other's first four letters, and one that is held has all its letters in fours
    in the other: entries are listed by both, and of a title's fours the rarest is looked up.
    """

    def __init__(self, hours: int):
        self.hours, self.entries = hours, []
        self.by_title, self.by_begin, self.by_four = defaultdict(list), defaultdict(list), defaultdict(list)

    @staticmethod
    def fours(title: str) -> set[str]:
        return {title[i : i + 4] for i in range(len(title) - 3)}

    def joined(self, title: str, hour: int, event_id: int) -> int:
        """The event that begins the first series which the title and hour fit; a new series if there is none."""
        fours = self.fours(title)
        near = list(self.by_title[title])
        near += [n for four in fours for n in self.by_begin.get(four, ()) if self.entries[n][0] in title]
        if fours:
            rarest = min(fours, key=lambda four: len(self.by_four.get(four, ())))
            near += [n for n in self.by_four.get(rarest, ()) if title in self.entries[n][0]]
        fit = min((n for n in near if abs(self.entries[n][1] - hour) <= self.hours), default=None)
        if fit is not None:
            return self.entries[fit][2]
        n = len(self.entries)
        self.entries.append((title, hour, event_id))
        self.by_title[title].append(n)
        if fours:
            self.by_begin[title[:4]].append(n)
            for four in fours:
                self.by_four[four].append(n)
        return event_id


_KEY = ["venue", "weekday", "title", "hour"]


def _keyed(events: DataFrame) -> DataFrame:
    """The events with what decides their series, `_title` and the like, and `_blocked`, whether they have a venue and an hour."""
    title = F.regexp_replace(normalised(F.col("title")), NUMBER, "")
    keyed = events.withColumns({"_title": title, "_venue": normalised(F.col("venue_name")), "_weekday": F.dayofweek("event_date"), "_hour": hour_of(F.col("event_time"))})
    return keyed.withColumn("_blocked", (F.col("_venue") != "") & F.col("_hour").isNotNull())


def _folded(keyed: DataFrame, window_hours: int) -> DataFrame:
    """venue, weekday, title, hour, their events' series and number (items): a row for each combination that occurs."""
    key = _KEY
    blocked = keyed.filter("_blocked").select("event_id", "event_date", *[F.col(f"_{k}").alias(k) for k in key])
    distinct = blocked.groupBy(*key).agg(F.min(F.struct(F.col("event_date").isNotNull().alias("dated"), "event_date", "event_id")).alias("first"), F.count(F.lit(1)).alias("items")).select(*key, "first.*", "items")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, firsts = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples():
                if (row.venue, row.weekday) != place:
                    place, firsts = (row.venue, row.weekday), _Firsts(window_hours)
                out.append(firsts.joined(row.title, row.hour, row.event_id))
            yield batch[[*key, "items"]].assign(series=out)

    ordered = distinct.repartition("venue", "weekday").sortWithinPartitions("venue", "weekday", "dated", "event_date", "event_id")
    return ordered.select(*key, "event_id", "items").mapInPandas(fold, "venue string, weekday int, title string, hour int, items long, series long")


def _answered(keyed: DataFrame, folded: DataFrame) -> DataFrame:
    """Blocked events with the columns of their combination; it is broadcast where its rows, once counted, are few."""
    named = folded.withColumnsRenamed({k: f"_of_{k}" for k in _KEY})
    named = F.broadcast(named) if folded.count() <= BROADCAST_KEYS else named
    return keyed.filter("_blocked").join(named, F.expr(" AND ".join(f"_{k} <=> _of_{k}" for k in _KEY)))


def series(events: DataFrame, window_hours: int = 2) -> DataFrame:
    """event_id and series of each event: the id of the series' first event.

    An event joins the first series, in order of date and id, whose first event has a like title and hour, of the same
    venue and weekday; titles are alike without their numbers if they are equal or one of at least four letters holds
    the other. Events that agree in venue, weekday, title and hour join the same series, so only the first of each goes
    through the fold, sorted by venue, weekday and date, and the others take its answer by a join. Events without a
    venue or hour start their own.
    """
    keyed = _keyed(events)
    met = _answered(keyed, written(_folded(keyed, window_hours), "series")).select("event_id", "series")
    return met.unionByName(keyed.filter(~F.col("_blocked")).select("event_id", F.col("event_id").alias("series")))


def rituals(events: DataFrame, now: Column, least: int = 3) -> DataFrame:
    """Events with a ritual keyword, and coming events of series of `least` or more among the others.

    A series' size is the sum of its combinations' events, so no event is sorted by its series.
    """
    marked = events.withColumn("_keyword", has_keyword(F.col("title"), F.col("description")))
    rest = _keyed(marked.filter(~F.col("_keyword")))
    folded = written(_folded(rest, window_hours=2), "series")
    sizes = folded.groupBy("series").agg(F.sum("items").alias("occurrences")).filter(F.col("occurrences") >= least)
    large = written(folded.join(sizes, "series"), "large_series")
    met = _answered(rest.filter(F.col("event_id").isNotNull() & (F.col("event_date") >= now)), large).select("event_id", "event_date", "occurrences")
    if least <= 1:  # an event without a venue or hour is a series of one
        alone = rest.filter(~F.col("_blocked") & F.col("event_id").isNotNull() & (F.col("event_date") >= now))
        met = met.unionByName(alone.select("event_id", "event_date", F.lit(1).cast("long").alias("occurrences")))
    pattern = met.select("event_id", F.lit("series").alias("reason"), "occurrences", F.date_format("event_date", "EEEE").alias("ritual_day"))
    keyword = marked.filter("_keyword").select("event_id", F.lit("keyword").alias("reason"), F.lit(None).cast("long").alias("occurrences"), F.date_format("event_date", "EEEE").alias("ritual_day"))
    return keyword.unionByName(pattern)


def streaks(attended: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """For each key the number of attended events from the newest past one back to the first miss.

    attended: keys, event_id, event_date, attended. A running count of misses, newest first, is 0 within the streak.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc("event_date"), F.desc("event_id"))
    past = attended.filter(F.col("event_date") <= now).withColumn("_misses", F.sum(F.when(F.col("attended"), 0).otherwise(1)).over(newest))
    return past.groupBy(*keys).agg(F.count_if(F.col("_misses") == 0).alias("streak"))
