"""One timeline from a person's events, bookmarks and calendar, with conflicts between neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def timeline(own: DataFrame, bookmarks: DataFrame, calendar: DataFrame, key: str) -> DataFrame:
    """key, id, kind, status, start, end, conflicts, day: own events win over bookmarks of the same id.

    Each source has key, id, start and end in epoch seconds, end null where unknown. An item conflicts with its
    neighbour in time if it begins before that one has ended, or that one before it has; both are marked.
    """
    shape = lambda rows, kind, status: rows.select(key, "id", F.lit(kind).alias("kind"), F.lit(status).alias("status"), "start", "end")
    mine = shape(own, "event", "confirmed")
    kept = shape(bookmarks, "event", "pending").join(mine.select(key, "id"), [key, "id"], "left_anti")
    items = mine.unionByName(kept).unionByName(shape(calendar, "calendar", "tentative")).filter(F.col("start").isNotNull())
    order = Window.partitionBy(key).orderBy("start", "kind", "id")
    until = F.coalesce("end", "start")
    before = F.coalesce(F.lag(until).over(order) > F.col("start"), F.lit(False))
    after = F.coalesce(until > F.lead("start").over(order), F.lit(False))
    return items.withColumns({"conflicts": before | after, "day": F.date_format(F.timestamp_seconds("start"), "EEEE, MMM d")})


def proposal_anchors(people: DataFrame, host_weight: float = 1.5) -> DataFrame:
    """group_id with its host's place and the weighted centre, in which the host counts more. Groups without a host have no row."""
    weight = F.coalesce(F.col("weight"), F.lit(1.0)) * F.when(F.col("is_host"), host_weight).otherwise(1.0)
    return people.groupBy("group_id").agg(
        F.max(F.when(F.col("is_host"), F.col("lat"))).alias("host_lat"), F.max(F.when(F.col("is_host"), F.col("lng"))).alias("host_lng"),
        (F.sum(F.col("lat") * weight) / F.sum(weight)).alias("fair_lat"), (F.sum(F.col("lng") * weight) / F.sum(weight)).alias("fair_lng"), F.count_if("is_host").alias("_hosts"),
    ).filter("_hosts > 0").drop("_hosts")


def select_places(places: DataFrame, least_population: int = 1000, most: int | None = None, names: list[str] | None = None) -> DataFrame:
    """Places by name, case ignored, or else by population; in order of population, `most` at most."""
    kept = places.filter(F.lower("name").isin([n.lower() for n in names])) if names else places.filter(F.col("population") >= least_population)
    ordered = kept.orderBy(F.desc("population"), "name")
    return ordered.limit(most) if most else ordered
