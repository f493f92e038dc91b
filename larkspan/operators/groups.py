"""Group geography and availability."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.geo import EARTH_KM, haversine_km
from larkspan.operators.components import connected
from larkspan.storage import written


def centroid(people: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Weighted mean position of each group, with the mean and largest distance of its members to it."""
    w = F.coalesce(F.col(weight), F.lit(1.0)) if weight else F.lit(1.0)
    centre = people.groupBy(*keys).agg((F.sum(F.col("lat") * w) / F.sum(w)).alias("centre_lat"), (F.sum(F.col("lng") * w) / F.sum(w)).alias("centre_lng"))
    away = people.join(centre, keys).withColumn("km", haversine_km(F.col("lat"), F.col("lng"), F.col("centre_lat"), F.col("centre_lng")))
    return away.groupBy(*keys, "centre_lat", "centre_lng").agg(F.avg("km").alias("mean_km"), F.max("km").alias("max_km"), F.count(F.lit(1)).alias("members"))


def _edges(row: Column, size: float) -> tuple[Column, Column]:
    """The least and the greatest distance of a row of cells from the equator, in degrees."""
    low, high = row * F.lit(size) - 90, (row + 1) * F.lit(size) - 90
    near = F.when((low <= 0) & (high >= 0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(high)))
    return near, F.least(F.lit(90.0), F.greatest(F.abs(low), F.abs(high)))


def _columns(row: Column, size: float) -> Column:
    """How many cells a row has around the globe: none is wider than `size` at its widest."""
    return F.greatest(F.lit(1), F.ceil(F.cos(F.radians(_edges(row, size)[0])) * F.lit(360.0 / size)).cast("int"))


def with_cells(people: DataFrame, size: float) -> DataFrame:
    """Adds the cell (row, col) of a grid in degrees of latitude, with cells about as wide as high everywhere."""
    placed = people.filter("lat IS NOT NULL AND lng IS NOT NULL").withColumn("row", F.floor((F.col("lat") + 90) / size).cast("int"))
    count = _columns(F.col("row"), size)
    return placed.withColumn("col", F.least(count - 1, F.floor(F.pmod(F.col("lng") + 180, F.lit(360.0)) / 360 * count).cast("int")))


def with_near_cells(cells: DataFrame, size: float, km: float, reach: int) -> DataFrame:
    """A row for each cell (near_row, near_col) that may hold a place within km of one in the cell, itself among them."""
    over = cells.withColumn("near_row", F.explode(F.sequence(F.col("row") - reach, F.col("row") + reach)))
    own, there = _columns(F.col("row"), size), _columns(F.col("near_row"), size)
    furthest = F.greatest(_edges(F.col("row"), size)[1], _edges(F.col("near_row"), size)[1])
    ratio = F.lit(math.sin(km / 2 / EARTH_KM) * 1.001) / F.greatest(F.cos(F.radians(furthest)), F.lit(1e-9))
    aside = F.when(ratio >= 1, F.lit(180.0)).otherwise(F.degrees(2 * F.asin(F.least(ratio, F.lit(1.0)))))
    first = F.floor((F.col("col") * 360 / own - aside) * there / 360).cast("int")
    last = F.floor(((F.col("col") + 1) * 360 / own + aside) * there / 360).cast("int")
    whole = F.sequence(F.lit(0), there - 1)
    return over.withColumn("near_col", F.explode(F.when(last - first + 1 >= there, whole).otherwise(F.transform(F.sequence(first, F.greatest(first, last)), lambda c: F.pmod(c, there)))))


def _degrees(km: float) -> float:
    return math.degrees(km / EARTH_KM)


def close_pairs(people: DataFrame, keys: list[str], km: float) -> DataFrame:
    """Pairs (a < b) of a group's members within km: an equi-join on the cells of a grid and their neighbours, then the distance."""
    size = _degrees(km) * 1.001
    held = with_cells(people.select(*keys, "user_id", "lat", "lng"), size)
    left = with_near_cells(held, size, km, 1).select(*keys, F.col("user_id").alias("a"), F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a"), F.col("near_row").alias("row"), F.col("near_col").alias("col"))
    right = held.select(*keys, F.col("user_id").alias("b"), F.col("lat").alias("lat_b"), F.col("lng").alias("lng_b"), "row", "col")
    met = left.join(right, [*keys, "row", "col"]).filter("a < b")
    return met.filter(haversine_km(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b")) <= km).select(*keys, "a", "b")


def linked_cells(people: DataFrame, keys: list[str], km: float) -> tuple[DataFrame, DataFrame]:
    """Cells (keys, row, col, members, least, lat_sum, lng_sum) whose members are all within km, and linked pairs of them.

    A cell's diagonal is under km, so its members are one cluster from the start. Two cells are linked if any member of
    one is within km of any of the other: the outermost members of each, in eight directions, say so for most; only the
    pairs that they leave open compare members, and of these only those in reach of the other cell's latitudes.
    """
    size = _degrees(km) / math.sqrt(2) * 0.999
    held = written(with_cells(people.select(*keys, "user_id", "lat", "lng"), size), "members")
    place, lat, lng = F.struct("lat", "lng"), F.col("lat"), F.col("lng")
    outermost = [f(place, by) for by in (lat, lng, lat + lng, lat - lng) for f in (F.min_by, F.max_by)]
    cells = held.groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("members"), F.min("user_id").alias("least"), F.sum("lat").alias("lat_sum"), F.sum("lng").alias("lng_sum"), F.min("lat").alias("low"), F.max("lat").alias("high"), F.array_distinct(F.array(*outermost)).alias("outer"))
    cells = written(cells, "cells")
    near = with_near_cells(cells.select(*keys, "row", "col", "low", "high", "outer"), size, km, 2).filter(F.struct("near_row", "near_col") > F.struct("row", "col"))
    other = cells.select(*keys, F.col("row").alias("near_row"), F.col("col").alias("near_col"), F.col("low").alias("near_low"), F.col("high").alias("near_high"), F.col("outer").alias("near_outer"))
    far = _degrees(km) * 1.001
    met = near.join(other, [*keys, "near_row", "near_col"]).filter((F.col("near_low") - F.col("high") <= far) & (F.col("low") - F.col("near_high") <= far))
    touch = F.exists("outer", lambda a: F.exists("near_outer", lambda b: haversine_km(a["lat"], a["lng"], b["lat"], b["lng"]) <= km))
    pair = [*keys, "row", "col", "near_row", "near_col"]
    met = written(met.select(*pair, "low", "high", "near_low", "near_high", touch.alias("linked")), "pairs")
    ours = held.select(*keys, "row", "col", F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a")).distinct()
    theirs = held.select(*keys, F.col("row").alias("near_row"), F.col("col").alias("near_col"), F.col("lat").alias("lat_b"), F.col("lng").alias("lng_b")).distinct()
    half = met.filter("NOT linked").join(ours, [*keys, "row", "col"]).filter(F.col("lat_a").between(F.col("near_low") - far, F.col("near_high") + far))
    both = half.join(theirs, [*keys, "near_row", "near_col"]).filter(haversine_km(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b")) <= km)
    return cells, met.filter("linked").select(*pair).unionByName(both.select(*pair).distinct())


def majority_clusters(people: DataFrame, keys: list[str], km: float = 5.0) -> DataFrame:
    """Each group's largest cluster of members linked within km, of two or more; ties to the one with the least member.

    Clusters are components of cells, not of members: what is shuffled after the first count is a row for each occupied
    cell and each pair of neighbouring ones. People without a position take no part.
    """
    cells, pairs = linked_cells(people, keys, km)
    node = lambda row, col: F.struct(*keys, F.col(row).alias("row"), F.col(col).alias("col"))
    labels = connected(pairs.select(node("row", "col").alias("a"), node("near_row", "near_col").alias("b")))
    named = labels.select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.row").alias("row"), F.col("node.col").alias("col"), "root")
    placed = cells.join(named, [*keys, "row", "col"], "left").withColumn("root", F.coalesce("root", node("row", "col")))
    sums = placed.groupBy(*keys, "root").agg(F.min("least").alias("cluster"), F.sum("members").alias("members"), (F.sum("lat_sum") / F.sum("members")).alias("hub_lat"), (F.sum("lng_sum") / F.sum("members")).alias("hub_lng"))
    first = Window.partitionBy(*keys).orderBy(F.desc("members"), "cluster")
    return sums.filter("members >= 2").withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*keys, "cluster", "members", "hub_lat", "hub_lng")


def merged_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks (keys, start, end) as the fewest that cover the same time: those that overlap or touch are one."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = blocks.select(*keys, "start", "end").filter(F.col("start") < F.col("end")).withColumn("_new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    numbered = flagged.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def common_slots(blocks: DataFrame, keys: list[str], people: DataFrame, start: Column, end: Column, minutes: int = 60, most: int = 5, universal_only: bool = False) -> DataFrame:
    """Slots in which members of a group are free together, best first: all of them, then most, then earliest.

    blocks: keys, user_id, start, end (epoch seconds); people: keys, total. Blocks within the window count. A sweep:
    each user's blocks are merged, so that at a moment a user comes or goes but not both; the changes of a moment are
    added up, and their running sum is the number of users until the next one. As every change changes who is free,
    the stretches between changes are the slots; those shorter than `minutes` go. A block costs two rows however long.
    """
    inside = merged_blocks(blocks.filter((F.col("start") < end) & (F.col("end") > start)), [*keys, "user_id"])
    ends = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("change")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("change"))))
    moments = inside.select(*keys, ends.alias("e")).groupBy(*keys, F.col("e.at").alias("slot_start")).agg(F.sum("e.change").alias("_change"))
    order = Window.partitionBy(*keys).orderBy("slot_start")
    free = moments.withColumns({"available": F.sum("_change").over(order.rowsBetween(Window.unboundedPreceding, 0)), "slot_end": F.lead("slot_start").over(order)})
    slots = free.filter((F.col("available") > 0) & ((F.col("slot_end") - F.col("slot_start")) >= minutes * 60)).join(people, keys)
    slots = slots.withColumn("is_universal", F.col("available") == F.col("total"))
    if universal_only:
        slots = slots.filter("is_universal")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("is_universal"), F.desc("available"), "slot_start"))
    return slots.withColumn("place", place).filter(F.col("place") <= most).select(*keys, "place", "slot_start", "slot_end", "available", "is_universal")
